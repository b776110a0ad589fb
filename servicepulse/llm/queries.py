"""The registered queries of this package: one per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from servicepulse.llm import ann, decontaminate, html_text, near_dup, neural_lm, ngram_join, periodic_runs, pieces, pii, quality, sharding, toxicity, whitening
from servicepulse.llm.common import read

SHARDS, SEED = 40, 20_240_501


def tokenizer_path() -> str:
    """The installed public SentencePiece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a conditional random field over its words."""
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document by anchor expansion."""
    return pii.scan(read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by an additive model with pairwise interactions."""
    return quality.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked at 0.8 on sets of 2-word shingles."""
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"), shingle=2, percent=80)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to 40 shards by a two-pass external shuffle; a digest of the written table."""
    return sharding.digest(sharding.write_shards(read(spark, sf_dir, "documents"), SHARDS, SEED))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents at 0.8 on five-word shingles."""
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by differencing with its nearest pages."""
    return html_text.extract(read(spark, sf_dir, "pages"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document and their decoding, as digests."""
    return pieces.encode(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), tokenizer_path(), "doc_id")


def op9_neural_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a log-bilinear model and under word counts."""
    return neural_lm.score_documents(read(spark, sf_dir, "documents"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    return ann.nearest(read(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's whitened coordinates on the eight principal components of all."""
    return whitening.whiten(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words (a tenth of the documents made periodic first), as digests."""
    return periodic_runs.digest(periodic_runs.periodic_runs(read(spark, sf_dir, "documents"), periodic_runs.plant_period))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked at 0.85 on sets of 4-word shingles."""
    return ngram_join.similar_components(read(spark, sf_dir, "documents"), shingle=4, percent=85)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_pii, op3_quality, op4_near_dup, op5_sharding, op6_decontamination, op7_html, op8_sentencepiece, op9_neural_lm, op10_ann, op11_whitening, op12_periodic_runs, op13_ngram_join)}

_WORDS = """regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""
_GRAM = " || ' ' || ".join(["ws[i]", *(f"ws[i + {k}]" for k in range(1, 5))])

_NEXT = " || ' ' || ".join(["ws[i]", *(f"ws[i + {k}]" for k in range(1, 4))])

ORACLES: dict[str, str] = {
    "op13_ngram_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN ws WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: {_NEXT}) END) AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e AS a JOIN e AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y WHERE c * 100 >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, b.y FROM reach JOIN both_ways AS b ON reach.r = b.x)
SELECT n.doc_id, n.n AS n_shingles, min(r) AS component_id FROM n JOIN reach ON reach.doc_id = n.doc_id GROUP BY n.doc_id, n.n""",
    "op4_near_dup": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e AS a JOIN e AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y WHERE c * 100 >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, b.y FROM reach JOIN both_ways AS b ON reach.r = b.x)
SELECT n.doc_id, n.n AS n_shingles, min(r) AS component_id, n.doc_id = min(r) AS kept FROM n JOIN reach ON reach.doc_id = n.doc_id GROUP BY n.doc_id, n.n""",
    # Items of five words or more (as all of the tables are), windows of their length at every position.
    "op6_decontamination": f"""WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
dg AS (SELECT doc_id, len(ws) AS words, unnest(list_transform(range(1, len(ws) - 3), lambda i: {{'p': i, 'g': {_GRAM}}})) AS u FROM d WHERE len(ws) >= 5),
ig AS (SELECT item_id, len(ws) AS n, unnest(list_transform(range(1, len(ws) - 3), lambda i: {_GRAM})) AS g FROM b WHERE len(ws) >= 5),
ic AS (SELECT item_id, n, g, count(*) AS ci FROM ig GROUP BY ALL),
hits AS (SELECT doc_id, item_id, n, words, u.p AS p, g FROM dg JOIN ic ON u.g = ic.g),
win AS (SELECT doc_id, item_id, n, words, g, unnest(range(greatest(1, p - n + 5), p + 1)) AS st FROM hits),
cw AS (SELECT doc_id, item_id, n, st, g, count(*) AS c FROM win WHERE st <= words - n + 1 GROUP BY ALL),
sc AS (SELECT doc_id, item_id, cw.n AS n, st, CAST(sum(least(c, ci)) AS BIGINT) AS shared FROM cw JOIN ic USING (item_id, g) GROUP BY ALL),
ok AS (SELECT *, 2 * (n - 4) - shared AS joint FROM sc WHERE shared * 100 >= 80 * (2 * (n - 4) - shared)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared DESC, st) AS r FROM ok)
SELECT doc_id, item_id, CAST(st - 1 AS BIGINT) AS first_word, CAST(n AS BIGINT) AS n_words, shared, CAST(joint AS BIGINT) AS joint,
  CAST(shared AS DOUBLE) / CAST(joint AS DOUBLE) AS similarity FROM best WHERE r = 1""",
}
