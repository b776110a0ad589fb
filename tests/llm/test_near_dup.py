"""Components against a brute-force join on full sets."""

from collections import Counter, defaultdict

import pytest
from corpus_paths import SF

from servicepulse.llm import near_dup


def sets(texts, k):
    out = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        out[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def brute(texts, k, percent=80):
    s = sets(texts, k)
    parent = {d: d for d in s}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = [d for d in sorted(s) if s[d]]
    holders = defaultdict(set)
    for d in ids:
        for g in s[d]:
            holders[g].add(d)
    for d in ids:
        for o in set().union(*(holders[g] for g in s[d])):
            if o < d and find(o) != find(d):
                shared = len(s[d] & s[o])
                if shared * 100 >= percent * (len(s[d]) + len(s[o]) - shared):
                    a, b = find(o), find(d)
                    parent[max(a, b)] = min(a, b)
    return {d: (len(s[d]), find(d)) for d in s}


@pytest.mark.parametrize("k", [2, 5])
def test_components_match_brute_force(spark, documents, k):
    got = near_dup.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet"), k).collect()
    want = brute(documents, k)
    assert len(got) == len(want)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_crowded_groups_lose_no_link(spark):
    """Several hundred near copies of one text, some of them only linked through others."""
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for d in range(400):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            w[rng.randrange(60)] = f"v{rng.randrange(10_000)}"
        texts[d] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, 2).collect()}
    assert got == {d: c for d, (_, c) in brute(texts, 2).items()}


def test_unlinked_classes_round_one_passage_lose_no_link(spark, monkeypatch):
    """Over 512 classes that hold one passage and too much of their own to be linked, and others that are linked by it."""
    import random

    rng = random.Random(4)
    passage = [f"p{i}" for i in range(101)]
    texts = {d: " ".join(passage + [f"o{d}x{i}" for i in range(rng.randrange(1, 61))]) for d in range(1400)}
    want = brute(texts, 2)
    alone = sum(d == c for d, (_, c) in want.items())
    assert 512 < alone < 1300
    monkeypatch.setattr(near_dup, "CROWD", 8)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, 2).collect()}
    assert got == {d: c for d, (_, c) in want.items()}


def test_edge_rows(edge, nothing):
    got = Counter(tuple(r) for r in near_dup.near_duplicates(edge, 5).collect())
    assert got[(2, 6, 1, False)] == 2 and got[(1, 6, 1, True)] == 1 and got[(3, 7, 1, False)] == 1
    assert got[(4, 0, 4, True)] == got[(5, 0, 5, True)] == got[(6, 0, 6, True)] == 1
    assert got[(None, 6, None, True)] == got[(None, 0, None, True)] == 1
    assert got[(7, 1, 7, True)] == 1 and got[(8, 1, 7, False)] == 1
    assert sum(n for r, n in got.items() if r[0] == 10 and r[2] == 9) == 1
    # An id with two texts is one document; a text of it links others to it.
    assert got[(12, 1, 12, True)] == 2 and got[(13, 1, 12, False)] == 1
    assert near_dup.near_duplicates(nothing, 5).collect() == []
