"""Scores, spans, pieces, windows and pages against brute force, round trips and held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from corpus_paths import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from servicepulse.llm import decontaminate, html_text, neural_lm, pieces, pii, quality, queries, sharding, toxicity
from servicepulse.llm.common import WordHashes, components, shingle_hashes, words_of

SF01 = "/root/testdata/sf0.01"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


# ---------------------------------------------------------------- personal data

SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def by_regex(t):
    out = {k: [] for k in SHAPES}
    for kind, shape in SHAPES.items():
        for m in re.finditer(shape, t):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                  "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out[kind].append(m.span())
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(list("0159.+-@ ()ab_%é\n") + ["4111 1111-11111111", "255.", "a@b.c", "+12 345", "256", "00", "..", "4"]), max_size=30))
def test_base_spans_equal_the_shapes(parts):
    t = "".join(parts)
    found = pii.find(t, pii.automaton())
    assert {k: found[k] for k in SHAPES} == by_regex(t)


def test_added_kinds_and_masking():
    a = pii.automaton()
    t = "see https://joe:pw@host.example/x, IBAN: DE89 3704 0044 0532 0130 00 and token = \"ab12cd34ef\" but tokens and account holder stay"
    f = pii.find(t, a)
    assert [t[x:y] for x, y in f["link"]] == ["https://joe:pw@host.example"]
    assert [t[x:y] for x, y in f["account"]] == ["DE89 3704 0044 0532 0130 00", "ab12cd34ef"]
    masked = pii.masked(t, f)
    assert "3704" not in masked and "ab12" not in masked and masked.endswith("but tokens and account holder stay")
    assert pii.masked("nothing here", pii.find("nothing here", a)) == "nothing here"


def test_pii_query(spark, documents):
    got = queries.op2_pii(spark, SF).collect()
    assert len(got) == len(documents)
    for r in got:
        want = by_regex(documents[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in SHAPES] == [len(v) for v in want.values()]
        text = ",".join(f"{k}:{a}:{b}" for k, v in want.items() for a, b in v)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["spans"].startswith(text)


# ---------------------------------------------------------------- pieces

def test_chunk_table_equals_the_library():
    codec = pieces.Codec(queries.tokenizer_path())
    assert codec.chunked
    rng = random.Random(1)
    letters = list(" abc  Thé\n\t.ß漢😀　é​\x01▁") + ["the", "   ", "<s>", "</s>", "<unk>", "<0x0A>", "\x00", "�", " \n "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    assert codec.encode(texts) == [codec._whole(t) for t in texts]


def test_sentencepiece_query(spark, documents):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    got = queries.op8_sentencepiece(spark, SF).collect()
    assert len(got) == len(documents)
    for r in got:
        ids = sp.encode(documents[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


# ---------------------------------------------------------------- classifiers

def auc(score, label):
    s, y = np.array(score), np.array(label)
    rank = s.argsort().argsort() + 1
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.mark.parametrize("query,label,folds,out,least", [(queries.op1_toxicity, "toxic", 4, 2, 0.78), (queries.op3_quality, "quality", 5, 0, 0.95)])
def test_held_out_accuracy(spark, query, label, folds, out, least):
    got = query(spark, SF01).collect()
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert all(r["held_out"] == (fold(r["doc_id"], folds) == out) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [(r["score"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert auc(*zip(*held)) >= least


def test_marginals_equal_enumeration():
    """Forward-backward against the sum over all label sequences."""
    rng = np.random.default_rng(4)
    t, e = rng.normal(size=(2, 2)), rng.normal(size=5)
    total, on = 0.0, np.zeros(5)
    for bits in range(32):
        y = [(bits >> i) & 1 for i in range(5)]
        w = math.exp(sum(a * b for a, b in zip(y, e)) + sum(t[y[i], y[i + 1]] for i in range(4)))
        total += w
        on += w * np.array(y)
    got = 1 / (1 + np.exp(-toxicity.marginals(e, np.array([5]), t)))
    assert np.allclose(got, on / total)


def test_crf_tags_and_spans(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioutnrs") for _ in range(rng.randint(3, 8)))
    docs = [([word() for _ in range(30)] + (["vilething"] if i % 4 == 0 else []), int(i % 4 == 0)) for i in range(400)]
    crf = toxicity.fit_crf(docs)
    assert crf.emission("vilething") > 2 > -2 > crf.emission("tonsure")
    crf.link = np.array([-2.0, 2.0, 4.0, 0.0, 0.0])
    rows = toxicity.detect(spark.createDataFrame([(1, "Tonsure, VileThing! vilething tune"), (2, None), (3, "")], "doc_id long, text string"), crf).collect()
    assert rows[0]["n_toxic"] == 2 and rows[0]["spans"] == "9:29" and rows[0]["score"] > rows[1]["score"] == rows[2]["score"]
    assert rows[1]["spans"] == "" and rows[1]["n_toxic"] == 0


def test_lookup_tables_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    gam = quality.fit_gam(x, y, np.ones(len(y)))
    assert (0, 1) in gam.pairs
    assert auc(gam.score(x), y) > 0.97


# ---------------------------------------------------------------- language model

def test_language_model_query(spark, documents):
    got = queries.op9_neural_lm(spark, SF).collect()
    words = {i: (t or "").encode().lower().split() for i, t in documents.items()}
    c, train = Counter(), [i for i in documents if fold(i, 5) != 1]
    for i in train:
        c.update(words[i])
    c[b""] = len(train)
    n, v = sum(c.values()), len(c)
    scale = math.log10(n + 0.5 * (v + 1))
    assert len(got) == len(documents)
    for r in got:
        w = [*words[r["doc_id"]], b""]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(r["doc_id"], 5) == 1, len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10(c[x] + 0.5) - scale for x in w), rel_tol=1e-9)
        assert r["score"] < 0


def _random_model(size, classes, seed=1):
    rng = np.random.default_rng(seed)
    p = rng.random(size + 1)
    kinds = neural_lm.Classes(rng.integers(0, classes, size) if size else np.zeros(0, int), p / p.sum())
    m = neural_lm.Params(size, kinds.n)
    m.rows[:] = rng.normal(0, 0.7, m.rows.shape)
    return m, kinds


def test_probabilities_are_normalised_over_all_words():
    for size, classes in ((90, 9), (1, 1), (0, 1)):
        m, kinds = _random_model(size, classes)
        scorer, every = neural_lm.Scorer(m, kinds), np.arange(size + 1)
        for one, two in ((0, size), (size + 1, size + 1), (size, 0)):
            assert math.isclose(np.exp(scorer(np.full(size + 1, one), np.full(size + 1, two), every)).sum(), 1, rel_tol=1e-4)


def test_classes_split_words_into_halves_of_like_vectors():
    rng = np.random.default_rng(0)
    t = np.concatenate([rng.normal(3, 0.1, (32, 4)), rng.normal(-3, 0.1, (32, 4))])
    kinds = neural_lm.Classes.of_vectors(t, np.full(65, 0.25))
    assert kinds.n == 9 and np.bincount(kinds.of).tolist() == [8] * 8 + [1]
    assert not set(kinds.of[:32]) & set(kinds.of[32:64])
    noise = kinds.noise(np.arange(9), rng)
    assert (kinds.of[noise] == np.arange(9)[:, None]).all()


@pytest.mark.parametrize("with_classes", [False, True])
def test_noise_contrastive_steps_learn(with_classes):
    """A sequence in which each word follows from the one before."""
    w, p = np.tile(np.arange(8), 4000), np.append(np.full(8, 1 / 8 - 1e-4), 8e-4)
    m, kinds = neural_lm.Params.start(p, 3), neural_lm.Classes(np.arange(8) % 3, p)
    if with_classes:
        m = m.with_classes(kinds, p)
    trainer = neural_lm.Trainer(m, kinds if with_classes else None, p, 1)
    p1, p2 = neural_lm.contexts(w, np.array([len(w)]), 9)
    for _ in range(4):
        trainer.feed(p1, p2, w)
    m = trainer.m if with_classes else trainer.m.with_classes(kinds, p)
    assert neural_lm.Scorer(m, kinds)(p1, p2, w)[2:].mean() > math.log(0.5)


def test_class_sums_take_exponentials_by_words_and_not_by_contexts(monkeypatch):
    """40 distinct words on either side make 1,600 contexts: 80 rows of exponentials, and the sums of the plain way."""
    m, kinds = _random_model(300, 17)
    scorer, rows = neural_lm.Scorer(m, kinds), []
    plain = scorer._exps
    monkeypatch.setattr(scorer, "_exps", lambda a, *rest: rows.append(len(a)) or plain(a, *rest))
    p1, p2 = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(200, 240)))
    got = scorer._class_sums(np.tile(p1, 3), np.tile(p2, 3))
    assert sum(rows) == 80
    q = m.r[p1].astype(float) @ m.c1 + m.r[p2].astype(float) @ m.c2
    expected = np.log(np.exp(q @ m.u[:, :-1].T + m.u[:, -1]).sum(axis=1))
    assert np.allclose(got, np.tile(expected, 3), rtol=1e-5, atol=1e-5)
    # Factors out of range: no overflow, the same sums.
    m.rows[:] *= 9
    q = 0 * q + m.r[p1].astype(float) @ m.c1 + m.r[p2].astype(float) @ m.c2
    s = q @ m.u[:, :-1].T + m.u[:, -1]
    top = s.max(axis=1)
    assert np.allclose(neural_lm.Scorer(m, kinds)._class_sums(p1, p2), top + np.log(np.exp(s - top[:, None]).sum(axis=1)), rtol=1e-4)


def test_tokens_are_the_words_of_the_texts_in_order():
    texts = [b"", b" ", b"\n a\x0b\x0cB  c\t", b"\x1c\x1d a\xc2\xa0b \x00x \x85\xff", b"A" * 10, b"\xe2\x80\x83 z\r\n", b"b a"]
    for raw in (pa.array(texts, pa.binary()), pa.array([b"dropped", *texts, b"too"], pa.binary()).slice(1, len(texts)), pa.array([b"x"], pa.binary())):
        ids, lengths, hashes = neural_lm.encode(raw)
        words = [[*t.lower().split(), neural_lm.END] for t in raw.to_pylist()]
        assert lengths.tolist() == [len(w) for w in words]
        assert hashes[ids].tolist() == [neural_lm._signed(neural_lm.xxhash.xxh3_64_intdigest(w)) for ws in words for w in ws]


def test_inner_steps_in_tiles_equal_steps_token_by_token():
    """Classes of 1 to 40 tokens: gradients of the tiles against those of each token for itself."""
    rng = np.random.default_rng(4)
    p = np.full(61, 1 / 61)
    kinds = neural_lm.Classes(np.arange(60) % 5, p)
    start = neural_lm.Params(60, kinds.n)
    start.rows[:] = rng.normal(0, 0.5, start.rows.shape)
    trainer = neural_lm.Trainer(start, kinds, p, 7)
    of = np.repeat(np.arange(5), (1, 8, 9, 40, 3))
    w = of + 5 * rng.integers(0, 12, len(of))
    q1 = np.zeros((len(w), trainer.WIDE), np.float32)
    q1[:, : neural_lm.DIM], q1[:, neural_lm.DIM] = rng.normal(0, 1, (len(w), neural_lm.DIM)), 1
    noise = kinds.noise(np.arange(5), np.random.default_rng(7))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    grads, moved = np.zeros((60, neural_lm.DIM + 1)), []
    for i, (x, k) in enumerate(zip(w, of)):
        q, gq = q1[i, : neural_lm.DIM + 1].astype(float), np.zeros(neural_lm.DIM + 1)
        for word, label in ((x, 1), *((n, 0) for n in noise[k])):
            g = label - sigmoid(start.t[word] @ q - math.log(neural_lm.INNER_NOISE / 12))
            gq += g * start.t[word]
            grads[word] += g * q
        moved.append(gq[: neural_lm.DIM])
    got = trainer._inner(q1, w, of, np.flatnonzero(np.r_[True, of[1:] != of[:-1]]))
    assert np.allclose(got, moved, atol=1e-4)
    squares = 1e-6 + (grads**2).mean(axis=1)
    assert np.allclose(trainer.m.t[:60], start.t[:60] + neural_lm.RATE * grads / np.sqrt(squares)[:, None], atol=1e-4)
    assert np.allclose(trainer.m.squares[start.T : start.T + 60], squares, rtol=1e-3)


def test_language_model_score_word_by_word(spark, monkeypatch):
    """The query's score against one recomputed from the parameters, a token at a time."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    trained, plain = [], neural_lm._train
    monkeypatch.setattr(neural_lm, "_train", lambda *a: trained.append(plain(*a)) or trained[-1])
    got = {r["doc_id"]: r["score"] for r in neural_lm.score_documents(docs).collect()}
    m, kinds = trained[0]
    texts = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), b""] for r in docs.collect()}
    c = Counter(w for i, ws in texts.items() if fold(i, 5) != 1 for w in ws)
    order = sorted((w for w in c if c[w] >= neural_lm.LEAST), key=lambda w: (-c[w], neural_lm._signed(neural_lm.xxhash.xxh3_64_intdigest(w))))
    number, size = {w: i for i, w in enumerate(order)}, len(order)
    assert size == m.size > 500
    rare = sum(n + 0.5 for w, n in c.items() if w not in number) + 0.5
    soft = lambda s: s - np.log(np.exp(s).sum())
    for i in sorted(texts, key=lambda i: len(texts[i]))[:60:3]:
        two, one, total = size + 1, size + 1, 0.0
        for w in texts[i]:
            k = number.get(w, size)
            q = m.r[one].astype(float) @ m.c1 + m.r[two].astype(float) @ m.c2
            total += soft(m.u[:, :-1] @ q + m.u[:, -1])[kinds.of[k]]
            mates = np.flatnonzero(kinds.of == kinds.of[k])
            total += soft(m.t[mates, :-1] @ q + m.t[mates, -1])[list(mates).index(k)]
            total += math.log((c[w] + 0.5) / rare) if k == size else 0
            two, one = one, k
        assert math.isclose(got[i], total / math.log(10), rel_tol=1e-4)


def test_language_model_gains_on_counts_whatever_the_partitions(spark):
    docs = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    runs = [{r["doc_id"]: r for r in neural_lm.score_documents(docs.repartition(p)).collect()} for p in (1, 13)]
    for i, r in runs[0].items():
        assert math.isclose(r["score"], runs[1][i]["score"], rel_tol=1e-3)
    held = [r for r in runs[0].values() if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert gain > 0.1


# ---------------------------------------------------------------- decontamination

def best_windows(texts, items, percent=80):
    out = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        for i, b in items.items():
            b = (b or "").encode().lower().split()
            if not b or len(b) > len(w):
                continue
            k = min(5, len(b))
            own = Counter(tuple(b[j : j + k]) for j in range(len(b) - k + 1))
            grams = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
            if not own.keys() & set(grams):
                continue
            n = len(b) - k + 1
            for p in range(len(grams) - n + 1):
                shared = sum((Counter(grams[p : p + n]) & own).values())
                if shared * 100 >= percent * (2 * n - shared) and shared / (2 * n - shared) > out.get((d, i), (0,))[0]:
                    out[(d, i)] = (shared / (2 * n - shared), p)
    return out


def test_windows_match_brute_force(spark, documents):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"]) for r in queries.op6_decontamination(spark, SF).collect()}
    assert got == best_windows(documents, items)


def test_edited_and_short_items(spark, edge, nothing):
    words = [f"q{i}" for i in range(50)]
    edited = words[:49] + ["other"]
    far = [w if i % 9 else "zz" for i, w in enumerate(words)]
    items = {1: " ".join(words), 2: "tiny item", 3: None, 4: "", 5: " ".join(["again"] * 12)}
    texts = {1: "lead in " + " ".join(words) + " out", 2: " ".join(edited) + " tail", 3: " ".join(far), 4: "a Tiny  ITEM here", 5: " ".join(["again"] * 40), 6: None, 7: ""}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"]) for r in decontaminate.contaminated(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), bench).collect()}
    assert got == best_windows(texts, items) and {(1, 1), (2, 1), (4, 2), (5, 5)} == set(got)
    assert decontaminate.contaminated(nothing, bench).collect() == []
    assert decontaminate.contaminated(edge, bench.limit(0)).collect() == []
    assert decontaminate.contaminated(edge, bench).collect() == []


def test_block_tables_find_all_within_radius():
    rng = np.random.default_rng(0)
    bench = decontaminate.Benchmark([(i, " ".join(f"a{rng.integers(999)}" for _ in range(30)).encode()) for i in range(50)], 5, 80)
    probe = np.packbits(rng.random((300, decontaminate.BITS)) < 0.5, axis=1)
    probe[:50] = bench.prints ^ np.packbits(rng.random((50, decontaminate.BITS)) < 0.3, axis=1)
    want = np.bitwise_count(probe[:, None, :] ^ bench.prints[None]).sum(axis=2) <= decontaminate.RADIUS
    assert want.any() and (bench.candidates(probe, np.arange(50)) == want).all()


def test_documents_shorter_than_an_item(spark):
    """A document that is an item less some words is compared as a whole; brute force over full sets."""
    words = [f"q{i}" for i in range(50)]
    texts = {k: " ".join(words[: 50 - k]) for k in range(16)} | {100 + k: " ".join(words[k:]) for k in range(16)} | {200: " ".join(words[:30] + words[31:]), 201: "q1 q2 q3", 202: " ".join(words[:20] * 2)}
    grams = lambda w: Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    want = {}
    for d, t in texts.items():
        own, item = grams(t.split()), grams(words)
        shared = (own & item).total()
        if shared * 100 >= 80 * ((own | item).total()):
            want[d] = (0, len(t.split()), shared, (own | item).total())
    assert {3, 9, 103, 200} <= want.keys() and not {10, 15, 201, 202} & want.keys()
    docs, bench = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = {r["doc_id"]: (r["first_word"], r["n_words"], r["shared"], r["joint"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == want
    assert {r["doc_id"] for r in decontaminate.without_contaminated(docs, bench).collect()} == texts.keys() - want.keys()


def test_long_items_beside_repeated_words():
    """Windows of weighted similarity just above 0.8 whose other shingles are one repeated word."""
    for trial in range(20):
        words = [f"t{trial}w{i}" for i in range(204)]
        bench = decontaminate.Benchmark([(1, " ".join(words).encode())], 5, 80)
        text = " ".join(["lead", "in", *words[:182], *["again"] * 60])
        shared, joint, first = bench.find(WordHashes().of(words_of(text.encode())))[0]
        assert shared * 100 < 81 * joint and {(1, 1): (shared / joint, first)} == best_windows({1: text}, {1: " ".join(words)})


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=40), st.integers(1, 40))
def test_votes_of_sliding_windows(values, width):
    s, width = shingle_hashes(WordHashes().of([str(v).encode() for v in values]), 1), min(width, len(values))
    sums = decontaminate.window_sums(s, width)
    assert len(sums) == len(s) - width + 1
    for p, total in enumerate(sums):
        seen, nth = Counter(), []
        for x in s[p : p + width].tolist():
            seen[x] += 1
            nth.append(seen[x])
        assert (decontaminate.votes(s[p : p + width], np.array(nth)).sum(axis=0) == total).all()


# ---------------------------------------------------------------- pages

def test_page_lines():
    page = (
        "<!doctype html><head><title>no</title><script>var a='</p>';</script></head><body class='comments-open'><!-- x --><nav><ul><li>Home<li>Up</ul></nav>"
        "<div class=\"cookie-notice\">we use</div><article><header><h1>A &amp; B</h1></header><p>one <b>two</b>\n three<br>four<p>five&nbsp;&lt;six"
        "<aside>see also</aside><form>name <input></form><div id='comments'><p>nice</div><p>last</article><footer>&copy;</footer></body>"
    )
    assert html_text.lines_of(page) == [("A & B", True), ("one two three four", True), ("five <six", True), ("last", True)]
    assert html_text.lines_of("") == [] and html_text.lines_of("plain <i>text") == [("plain text", False)]
    assert html_text.lines_of("<script>unclosed") == [] and html_text.lines_of("a<!-- unclosed") == [("a", False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    got = html_text.common(a, b)
    assert len(got) == table[-1][-1] and all(a[i] == b[j] for i, j in got)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_template_lines_go(spark):
    page = lambda own: f"<div>Site name</div><div>Start</div><p>{own} text</p><p>{own} more</p><div>Imprint</div>"
    rows = [(i, f"http://h.example/a/{i}?x=1", page(f"n{i}")) for i in range(5)]
    rows += [(9, None, None), (10, "", ""), (11, "http://other.example/", "<p>alone</p>"), (12, "http://c.example/1", page("same")), (13, "http://c.example/1", page("same"))]
    rows += [(14, "http://a.example/1", "<article><p>shared</p><p>x</p></article>"), (15, "http://a.example/2", "<article><p>shared</p><p>y</p></article>")]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    assert [got[i]["text"] for i in range(5)] == [f"n{i} text\nn{i} more" for i in range(5)]
    assert got[9]["text"] == got[10]["text"] == "" and got[11]["text"] == "alone" and got[9]["url"] is None
    # Copies of a page tell nothing about the template.
    assert got[12]["text"] == got[13]["text"] == "Site name\nStart\nsame text\nsame more\nImprint"
    assert got[14]["text"] == "shared\nx" and got[15]["n_chars"] == 8


def _texts(spark, rows, **more):
    """page_id -> text of (page_id, url, html) rows."""
    return {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), **more).collect()}


def test_notice_that_recurs_in_articles_goes(spark):
    own = lambda i: "".join(f"<p>own {i} {k} of this article</p>" for k in range(4))
    rows = [(i, f"http://n.example/{i}", f"<div>Site</div><article>{own(i)}<p>All rights reserved</p></article>") for i in range(5)]
    # Two pages that share a passage, and three copies of an article with a line of their own each, keep what they share.
    rows += [(10 + i, f"http://p.example/{i}", f"<article>{own(i)}<p>passage</p></article>") for i in range(2)]
    rows += [(20 + i, f"http://c.example/{i}", f"<article>{own(0)}<p>copy {i}</p></article>") for i in range(3)]
    got = _texts(spark, rows)
    lines = lambda i: [f"own {i} {k} of this article" for k in range(4)]
    assert [got[i].split("\n") for i in range(5)] == [lines(i) for i in range(5)]
    assert [got[10 + i].split("\n") for i in range(2)] == [[*lines(i), "passage"] for i in range(2)]
    assert [got[20 + i].split("\n") for i in range(3)] == [[*lines(0), f"copy {i}"] for i in range(3)]


def test_copies_in_a_row_are_cleaned_by_the_pages_that_differ(spark):
    page = lambda own: f"<div>Site name</div><p>{own} text</p><div>Imprint</div>"
    rows = [(0, "http://h.example/a", page("first"))] + [(i, f"http://h.example/b?v={i}", page("same")) for i in range(1, 1500)] + [(1500, "http://h.example/c", page("last"))]
    got = _texts(spark, rows, group=2000)
    assert len(got) == 1501 and [got[0], got[1500]] == ["first text", "last text"]
    assert {got[i] for i in range(1, 1500)} == {"same text"}


def test_large_hosts_give_what_one_range_gives(spark):
    """Sections with a menu of their own, copies that run over whole ranges, null ids and repeated rows."""
    rng = random.Random(5)
    page = lambda menu, own: f"<div>Site</div><div>Menu {menu}</div><p>{own} text</p><p>last words</p>"
    rows = [(i, f"http://big.example/s{i % 40:02}/{i}", page(i % 40, i)) for i in range(400)]
    rows += [(1000 + i, f"http://big.example/s20x/y?v={i}", page(20, "copy")) for i in range(200)]
    rows += [(2000 + i, f"http://big.example/s30x/{i}", f"<article>{''.join(f'<p>{i} {k} own words</p>' for k in range(3))}<p>notice</p></article>") for i in range(60)]
    rows += [(3000 + i, f"http://small.example/{i}", page(0, i)) for i in range(3)] + [(None, "http://big.example/s05/q", page(5, "none"))] * 2
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    read = lambda group: sorted(((-1 if r["page_id"] is None else r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_text.extract(docs, group).collect()))
    whole = read(10_000)
    assert len(whole) == len(rows) and read(7) == whole
    assert {t for i, _, t, _ in whole if 0 <= i < 400} == {f"{i} text" for i in range(400)}
    assert {t for i, _, t, _ in whole if 1000 <= i < 1200} == {"copy text"}
    assert not any("notice" in t for i, _, t, _ in whole if i >= 2000)


def test_pages_query(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    from html import unescape

    got = queries.op7_html(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search("<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


# ---------------------------------------------------------------- shards

def test_shards(spark, documents):
    got = queries.op5_sharding(spark, SF).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == len(documents) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    for r in got:
        raw = (documents[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    # Neighbours in the table are spread: the order is a shuffle.
    place = sorted(((r["doc_id"], (r["shard"], r["slot"])) for r in got))
    assert sum(a[1] < b[1] for a, b in zip(place, place[1:])) < 0.65 * len(place)


def test_shard_files_hold_the_rows_in_slot_order(spark, edge, nothing, tmp_path):
    path = str(tmp_path / "shards")
    table = sharding.write_shards(edge, 3, seed=1, path=path, bucket_bytes=4096)
    assert table.count() == edge.count() and "text" in table.columns and table.columns.count("size") == 1
    again = sharding.write_shards(edge.repartition(5), 3, seed=1, bucket_bytes=4096)
    key = lambda t: sorted((r["shard"], r["slot"], r["doc_id"] or -1, r["text"] or "") for r in t.select("shard", "slot", "doc_id", "text").collect())
    assert key(table) == key(again)
    assert sharding.write_shards(nothing, 3, seed=1).collect() == []
    assert sorted(r["text_crc32"] for r in sharding.digest(table).where("size = 16").collect()) == [0, 0, 0]


# ---------------------------------------------------------------- edge rows for the scans

def test_edge_rows_of_the_scans(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (9, 1), (7, 0), (3, 1), (None, 1), (4, 0)], "doc_id long, label int")
    from pyspark.sql import functions as F

    n = edge.count()
    none = labels.limit(0)
    for have in (labels, none):
        crf = toxicity.train(edge, have, F.lit(True))
        rows = toxicity.detect(edge, crf).collect()
        assert len(rows) == n and all(0 <= r["score"] <= 1 for r in rows)
        gam = quality.train(edge, have, F.lit(True))
        scored = quality.score(edge, gam, "doc_id", "score", name="own").collect()
        assert len(scored) == n and all(0 <= r["own"] <= 1 for r in scored) and {r["own"] for r in scored if r["doc_id"] in (4, 5, 6)} == {0.0}
        assert toxicity.detect(nothing, crf).collect() == quality.score(nothing, gam, "doc_id").collect() == []
    found = pii.scan(edge, mask=True).collect()
    assert len(found) == n and all(r["spans"] == "" for r in found) and sum(r["masked"] is None for r in found) == 2
    assert pii.mask_documents(edge).collect() == edge.collect() and pii.scan(nothing).collect() == []
    coded = pieces.encode(edge, queries.tokenizer_path(), "doc_id", "label", ids=True).collect()
    assert len(coded) == n and all(r["n_tokens"] == len(r["ids"]) for r in coded) and sorted(r["n_tokens"] for r in coded)[:3] == [0, 0, 0]
    assert pieces.encode(nothing, queries.tokenizer_path(), "doc_id").collect() == []
    lm = neural_lm.score_documents(edge).collect()
    assert len(lm) == n and all(math.isfinite(r["score"]) for r in lm) and {r["n_tokens"] for r in lm if r["doc_id"] in (4, 5, 6)} == {1}
    assert neural_lm.score_documents(nothing).collect() == []
    alone = neural_lm.score(edge, F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in alone)
    assert html_text.extract(nothing.selectExpr("id AS page_id", "text AS url", "text AS html", "text AS host", "text AS path")).collect() == []


# ---------------------------------------------------------------- helpers

def test_components_helper(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (200, 200)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 103: 100, 105: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_words_and_shingles():
    assert words_of("Äb CD\x0be f G".encode()) == ["Äb".encode(), b"cd", "e f g".encode()]
    h = WordHashes().of([b"a", b"b", b"a", b"b"])
    s = shingle_hashes(h, 2)
    assert len(s) == 3 and s[0] == s[2] != s[1] and len(shingle_hashes(h, 9)) == 1 and len(shingle_hashes(h[:0], 2)) == 0
