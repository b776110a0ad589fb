"""Whitening, periodic runs and the n-gram join against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from corpus_paths import SF
from pyspark.sql import functions as F

from servicepulse.llm import ngram_join, periodic_runs, queries, whitening

# ---------------------------------------------------------------- op11


def _whole(rows):
    return np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in rows], np.int64)


def _check_whitened(got, ids, x, k):
    """``got``: rows of the operator; ``x``: the whole-numbered vectors of ``ids``."""
    n, d = x.shape
    s = x.sum(axis=0)
    y = x - s / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == n * min(k, d)
    by = defaultdict(list)
    for r in got:
        assert r["n"] == n
        by[r["component"]].append(r)
    deviation = {i: sum((n * int(e) - int(t)) ** 2 for e, t in zip(v, s)) for i, v in zip(ids, x)}
    assert sorted(by) == list(range(1, min(k, d) + 1))
    for c, rows in by.items():
        assert {r["vec_id"]: r["deviation"] for r in rows} == deviation
        e = values[c - 1]
        assert all(r["explained"] == pytest.approx(e / values.sum(), rel=1e-9, abs=1e-15) for r in rows)
        if e <= 1e-9 * values[0]:
            continue
        own = dict(zip(ids, y @ vectors[:, c - 1] / np.sqrt(e)))
        gap = min(abs(values[j] - e) for j in range(d) if j != c - 1) / e if d > 1 else 1
        if gap > 1e-6:
            sign = 1 if all(abs(r["whitened"] - own[r["vec_id"]]) < 1e-6 for r in rows) else -1
            assert all(r["whitened"] == pytest.approx(sign * own[r["vec_id"]], abs=1e-6) for r in rows)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whitening_query_against_one_matrix(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").where("embedding is not null").collect()
    got = queries.op11_whitening(spark, SF).collect()
    _check_whitened(got, [r["vec_id"] for r in rows], _whole([r["embedding"] for r in rows]), 8)


@pytest.mark.parametrize("parts", [1, 7])
def test_whitening_of_hard_vectors(spark, parts):
    """Repeated vectors, equal and empty directions, nulls, non-finite entries, a clashing column."""
    rng = np.random.default_rng(2)
    base = np.round(rng.normal(size=(60, 5)), 3)
    base[:, 3] = base[:, 1]
    base[:, 4] = 2.0
    rows = [(i, base[i % 40].tolist(), 1, 2.0) for i in range(300)]
    bad = [(1000, None), (1001, [1.0, None, 1.0, 1.0, 1.0]), (1002, [1.0, float("nan"), 1.0, 1.0, 1.0]), (1003, [float("inf")] * 5), (1004, []), (1005, [1.0, 2.0])]
    df = spark.createDataFrame(rows + [(i, v, 1, 2.0) for i, v in bad], "vec_id long, embedding array<double>, component int, whitened double").repartition(parts)
    got = whitening.whiten(df).collect()
    x = _whole([r[1] for r in rows])
    _check_whitened(got, [r[0] for r in rows], x, 8)
    assert all((r["whitened"] is None) == (r["component"] > 3) for r in got)


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (None, [])], schema)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(None, [0.5, 1.0])], schema)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(c, 1, 0, None, None, None) for c in (1, 2)]


def test_rank_one_updates_give_the_spectrum():
    rng = np.random.default_rng(0)
    for kind in range(5):
        x = rng.normal(size=(400, 12)) * 100
        if kind == 1:
            x[:, 5], x[:, 7] = x[:, 6], 3
        if kind == 2:
            x = np.repeat(x[:20], 20, axis=0)
        if kind == 3:
            x = np.eye(12)[rng.integers(0, 12, 400)] * 500
        if kind == 4:
            x = x * np.logspace(0, -5, 12)
        x = np.floor(x).astype(np.int64) + 100_000
        a, b = whitening.Spectrum(12), whitening.Spectrum(12)
        for i in range(0, 200, 70):
            a.add(x[i : min(i + 70, 200)])
        for i in range(200, 400, 7):
            b.add(x[i : i + 7][: 400 - i])
        a.combine(b)
        y = x - x.mean(axis=0)
        m = y.T @ y
        assert a.n == 400 and (a.sums == x.sum(axis=0)).all()
        assert np.abs(a.q.T @ a.q - np.eye(12)).max() < 1e-12
        assert np.abs(a.q * a.lam @ a.q.T - m).max() < 1e-11 * np.abs(m).max()
        assert (np.diff(a.lam) >= 0).all()


def test_deviation_beyond_long_is_null():
    x = np.array([[1 << 20, 3], [5, 2]], np.int64)
    n, rest = 1 << 12, np.array([7, 1])
    assert whitening._squares(x, rest, n) == [None if (v := sum((n * int(e) - int(r)) ** 2 for e, r in zip(row, rest))) >= 1 << 63 else v for row in x]


# ---------------------------------------------------------------- op12


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and w[i] == w[i - q]:
                i += 1
            length = i - start
            seg = w[start:i]
            if length >= max(24, 3 * q) and not any(all(seg[t] == seg[t - p] for t in range(p, length)) for p in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _texts(rng, count):
    for _ in range(count):
        n, kind = rng.randrange(0, 200), rng.randrange(5)
        if kind == 0:
            w = [rng.choice("ab") for _ in range(n)]
        elif kind == 1:
            u = [rng.choice("abc") for _ in range(rng.randrange(1, 40))]
            w = (u * (n // len(u) + 1))[:n]
            for _ in range(rng.randrange(4) if w else 0):
                w[rng.randrange(n)] = rng.choice("abcd")
        elif kind == 2:
            w = []
            while len(w) < n:
                w += [rng.choice("ab") for _ in range(rng.randrange(1, 12))] * rng.randrange(1, 15)
        elif kind == 3:
            k, w = rng.randrange(3, 60), []
            while len(w) < n:
                w += ["a"] * (k + rng.choice([0, 0, 1])) + ["b"]
        else:
            w = [str(rng.randrange(60)) for _ in range(n)]
            if n > 4:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randrange(3, 11)
                w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        yield w


def test_runs_match_brute_force():
    rng, found = random.Random(5), 0
    for w in _texts(rng, 1500):
        want = brute_runs(w)
        assert periodic_runs.find_runs([x.encode() for x in w]) == want
        found += len(want)
    assert found > 1000


def test_long_periodic_texts_take_no_quadratic_time():
    assert periodic_runs.find_runs([b"a"] * 300_000) == [(0, 300_000, 1)]
    row = [b"a"] * 40 + [b"b"] + [b"a"] * 41 + [b"b"]
    runs = periodic_runs.find_runs(row * 1500)
    assert (0, 83 * 1500, 83) in [(s, n, p) for s, n, p in runs if p == 83] and len(runs) == 3001


def _expected(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w) if len(w) < 400 else periodic_runs.find_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines.encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_query_against_brute_force(spark, documents):
    got = sorted(map(tuple, queries.op12_periodic_runs(spark, SF).select(*COLUMNS).collect()))
    assert got == sorted(_expected(d, t) for d, t in documents.items())
    assert sum(r[1] > 0 for r in got) > 10


def test_runs_of_edge_rows(spark, edge, nothing):
    df = periodic_runs.digest(periodic_runs.periodic_runs(edge.withColumn("raw", F.lit("r")).withColumn("start", F.lit(1)), periodic_runs.plant_period))
    key = lambda r: tuple((v is None, v) if not isinstance(v, str) else (False, v) for v in r)
    assert sorted(map(tuple, df.select(*COLUMNS).collect()), key=key) == sorted((_expected(r["doc_id"], r["text"]) for r in edge.collect()), key=key)
    assert periodic_runs.digest(periodic_runs.periodic_runs(nothing)).collect() == []


def test_collapsed_text_keeps_what_no_run_repeats(spark):
    text = "x y " + "a b c " * 12 + "z"
    df = spark.createDataFrame([(3, text)], "doc_id long, text string")
    r = periodic_runs.periodic_runs(df).first()
    assert (r["n_words"], r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (39, 1, 2, 36, 3, 12_000)
    assert r["collapsed"] == "x y a b c z" and [tuple(x) for x in r["runs"]] == [(2, 36, 3)]


# ---------------------------------------------------------------- op13


def _sets(rows, k):
    for d, t in rows:
        w = (t or "").encode().lower().split()
        yield d, frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k=4, percent=85):
    rows = list(_sets(rows, k))
    parent = {d: d for d, _ in rows if d is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    known = sorted({(d, s) for d, s in rows if d is not None and s}, key=lambda x: x[0])
    for i, (d, s) in enumerate(known):
        for e, t in known[:i]:
            if find(d) != find(e) and min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)):
                c = len(s & t)
                if c * 100 >= percent * (len(s) + len(t) - c):
                    a, b = find(d), find(e)
                    parent[max(a, b)] = min(a, b)
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in rows), key=str)


def _components(df, **kw):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(df, **kw).collect()), key=str)


def test_join_matches_brute_force(spark, documents):
    got = _components(spark.read.parquet(f"{SF}/documents.parquet"))
    assert got == brute_components(documents.items()) and any(c != d for d, _, c in got)


def test_join_of_edge_rows(spark, edge, nothing):
    assert _components(edge) == brute_components([(r["doc_id"], r["text"]) for r in edge.collect()])
    assert _components(nothing) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_join_at_the_threshold(spark, seed, monkeypatch):
    """Chains of near copies, a shared passage with little of one's own, repeated texts and ids; hot shingles from 8 groups on."""
    monkeypatch.setattr(ngram_join, "HOT", 8)
    rng = random.Random(seed)
    rows, texts = [], []
    for f in range(6):
        base = [f"f{f}w{i}" for i in range(rng.randrange(8, 60))]
        for _ in range(25):
            w = list(rng.choice(texts[-10:]) if texts and rng.random() < 0.4 else base)
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = [f"n{rng.randrange(30)}"] * rng.randrange(2)
            texts.append(w or base)
    passage = [f"p{i}" for i in range(50)]
    texts += [[f"o{i}x{j}" for j in range(rng.randrange(1, 7))] + passage for i in range(60)]
    texts += [rng.choice(texts) for _ in range(40)]
    for i, w in enumerate(texts):
        rows.append((rng.randrange(250) if rng.random() < 0.1 else 300 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert _components(df) == brute_components(rows)


def test_members_of_one_group_that_differ_after_the_prefix(spark):
    """Equal prefix and size, sets that do not link, in a group with some that do."""
    rare = [f"r{i}" for i in range(9)]
    rows, n = [], 0
    for block in range(4):
        tail = [f"t{block}x{j}" for j in range(30)]
        for copy in range(6):
            w = rare + tail
            if copy % 2:
                w = w[:-1] + [f"z{copy % 3}"]
            rows.append((n := n + 1, " ".join(w)))
        rows += [((n := n + 1), " ".join(tail)) for _ in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _components(df) == brute_components(rows)


# ---------------------------------------------------------------- op5, rows that are equal


def test_equal_rows_do_not_share_one_bucket(spark, monkeypatch):
    """Nine rows in ten are equal; columns have the names that a bucket, a place and a key had."""
    from servicepulse.llm import sharding

    rows = [(7, "same text " * 5, "b", 1, "k")] * 1800 + [(i, f"text {i}", "b", i, None) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string, place long, order_key string")
    sizes = []
    monkeypatch.setattr(sharding, "materialize", lambda d, name, m=sharding.materialize: sizes.append((name, t := m(d, name))) or t)
    tables = [sharding.write_shards(df.repartition(p), 7, 5, bucket_bytes=4096) for p in (2, 9)]
    counts = [t for name, t in sizes if name == "shard-buckets"]
    assert counts[0].agg(F.max("n")).first()[0] < 4 * counts[0].agg(F.avg("n")).first()[0]
    got = [sorted(map(tuple, t.select("shard", "slot", "doc_id", "text", "bucket", "place", "order_key").collect())) for t in tables]
    assert got[0] == got[1]
    assert sorted((r[2:] for r in got[0]), key=str) == sorted(rows, key=str)
    per = defaultdict(list)
    for r in got[0]:
        per[r[0]].append(r[1])
    assert all(sorted(v) == list(range(len(v))) for v in per.values()) and {len(v) for v in per.values()} <= {2000 // 7, 2000 // 7 + 1}
    runs = sum(a[2] == b[2] == 7 for a, b in zip(got[0], got[0][1:]))
    assert runs < 1750  # the copies stand among the others


def test_place_of_every_row_is_that_of_its_bucket_shuffled(spark):
    """The order recomputed: buckets by hash, their rows by key, each shuffled by Fisher-Yates."""
    from servicepulse.llm import sharding

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").dropDuplicates()
    shards, seed, bucket_bytes = 7, 5, 1 << 14
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.write_shards(docs, shards, seed, bucket_bytes=bucket_bytes).collect()}
    rows = docs.select("doc_id", F.xxhash64(F.lit(seed), "doc_id", "text").alias("k"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("size")).collect()
    buckets = max(1, -(-sum(r["size"] for r in rows) // bucket_bytes))
    order = []
    for b in range(buckets):
        own = sorted((r["k"], r["doc_id"]) for r in rows if r["k"] % buckets == b)
        order += [own[i][1] for i in sharding.fisher_yates(len(own), seed, b)]
    n = len(order)
    starts = [s * n // shards for s in range(shards + 1)]
    assert got == {d: (s, p - starts[s]) for p, d in enumerate(order) for s in [next(s for s in range(shards) if starts[s] <= p < starts[s + 1])]}


# ---------------------------------------------------------------- op7, blocks of an article


def test_blocks_of_an_article_stay_whatever_they_are_about(spark, nothing):
    """Ids and classes that only contain a cue word name what a block is about; whole class names of furniture do not."""
    from servicepulse.llm import html_text

    html = (
        "<html><body><div class='menu-top'>Menu</div><div id='cookie-notice'>Cookies</div><article><h1>Title</h1><div id='related-work'>Related work</div><section id='search-methods'><p>Methods</p></section>"
        "<p class='skip-intro'>Intro <math><mi>x</mi><mo>+</mo><mi>y</mi></math> end</p><p class='lead notice-board'>Board</p><div class='box share'>Share</div><div class='newsletter'>News</div>"
        "<section id='comments'><p>First!</p></section><ul class='comments'><li>No</li></ul><p>Last</p></article><footer>Foot</footer></body></html>")
    pages = spark.createDataFrame([(1, "http://a.example/x", html, "t", 0)], "page_id long, url string, html string, text string, n_chars int")
    r = html_text.extract(pages).first()
    assert r["text"] == "Title\nRelated work\nMethods\nIntro x+y end\nBoard\nLast" and r["n_chars"] == len(r["text"])


def test_very_long_pages_and_clashing_columns(spark):
    from servicepulse.llm import html_text

    body = "".join(f"<p>Line {i} of {i % 13}</p>" for i in range(20_000))
    rows = [(i, f"http://a.example/long/{i}", f"<body><nav>n</nav><article>{body}<p>own {i}</p></article></body>", "host", 3) for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, lines int")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    want = "\n".join(f"Line {i} of {i % 13}" for i in range(20_000))
    assert got == {i: f"{want}\nown {i}" for i in range(3)}
