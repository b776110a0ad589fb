"""Neighbours against an exact search; the pipeline against its stages' rules."""

import math
from collections import Counter, defaultdict

import numpy as np
from corpus_paths import SF

import corpus_pipeline
from servicepulse.llm import ann, queries


def exact(rows, k=5, every=50):
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = defaultdict(dict)
    for q, a in rows:
        if q % every == 0:
            for i, b in rows:
                if i != q and len(a) == len(b):
                    s = float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
                    out[q][i] = max(s, out[q].get(i, -2))
    return {q: sorted(((-round(s, 9), i) for i, s in c.items()))[:k] for q, c in out.items()}


def test_neighbours_query(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = exact(rows), defaultdict(list)
    for r in queries.op10_ann(spark, SF).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-round(r["score"], 9), r["vec_id"]))
    assert set(got) == set(want)
    hits = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all(v == sorted(v) for v in got.values())


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(0, 400)]  # one vector, many copies
    rows += [(1000 + i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    rows += [(50, [1.0, 2.0, 3.0, 4.0]), (2000, None), (2050, []), (2100, [0.0] * 4), (2150, [1.0, None, 2.0, 3.0]), (2200, [float("nan")] * 4),
             (2250, [float("inf"), 0.0, 0.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0]), (2300, [1.0, 2.0]), (2350, [1e-200, 1e-200, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, ids int, rank string")
    got = defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    assert got[0] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)] and got[50] == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert set(got) == {*range(0, 400, 50), 1000, 1050, 2350} and all(len(v) == 5 for v in got.values())
    few = ann.nearest(df.where("vec_id in (1000, 1001, 1002)")).collect()
    assert sorted(r["vec_id"] for r in few) == [1001, 1002]
    assert ann.nearest(df.limit(0)).collect() == [] and ann.nearest(df.where("vec_id = 1000")).collect() == []


def test_probing_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 62, size=(3000, 4), dtype=np.uint64)
    codes[1500:] = codes[:1500] ^ (np.uint64(1) << rng.integers(0, 60, size=(1500, 4), dtype=np.uint64))
    index = ann.Index(codes)
    for q in codes[:20]:
        for radius in (0, 3, 4, 9, 11, 90, 110):
            assert index.within(q, radius).tolist() == np.flatnonzero(ann.hamming(codes, q) <= radius).tolist()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dup", "decontamination", "pii", "sentencepiece"]
    kept = docs
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns and [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema]
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        now = kept.count()
        assert now <= before if name != "pii" else now == before
        before = now
    assert 0.6 * docs.count() < before < docs.count()
    from servicepulse.llm import decontaminate, near_dup, pii

    assert near_dup.near_duplicates(kept, 5).where("not kept").count() == 0
    assert decontaminate.contaminated(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert pii.scan(kept).where("spans <> ''").count() == 0
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in kept.collect())


def test_pipeline_on_edge_rows(spark, edge, nothing):
    for table in (edge, nothing):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            assert name == "sentencepiece" or docs.columns == edge.columns
        docs.collect()
