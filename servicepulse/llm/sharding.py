"""Random shards by a two-pass external shuffle.

Pass 1 scatters the records into buckets small enough for memory, by a seeded
hash of the record; their row counts give each bucket its place in the final
order.  Pass 2 takes one bucket at a time, shuffles it with a seeded
Fisher-Yates shuffle, and writes its records to the shards that its place
covers.  The law is ``rows``: shard ``s`` of ``S`` holds the positions from
``floor(s N / S)`` up to ``floor((s + 1) N / S)``, so counts are at most one apart.

Rows equal in every column have one hash.  Where those of one hash are more than a
part of a bucket, they are counted instead of scattered, and written out as that many copies, each with a
bucket of its own by the hash of its number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from servicepulse.llm.common import broadcast_rows, map_arrow
from servicepulse.session import materialize, scratch_path

#: Text bytes of a bucket on average, and buckets whose places may be broadcast.
BUCKET_BYTES = 16 << 20
BROADCAST_BUCKETS = 1_000_000
#: Rows of one hash that hold more than this part of a bucket's bytes are counted; tasks of the second pass at most.
HOT_PART, TASKS = 8, 20_000
_OWN = ("size", "shard", "slot")
_BUCKET, _PLACE, _KEY = "__bucket", "__place", "__order_key"


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of 0..n-1; numpy's shuffle is Fisher-Yates."""
    order = np.arange(n)
    np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)
    return order


def _shuffled(batches: Iterator[pa.RecordBatch], seed: int, total: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket in; each bucket's rows in their final order out, with shard and slot."""

    def emit(parts: list[pa.RecordBatch], bucket: int):
        table = pa.Table.from_batches(parts)
        order = fisher_yates(table.num_rows, seed, bucket)
        pos = table[_PLACE][0].as_py() + np.arange(len(order), dtype=np.int64)
        shard = ((pos + 1) * shards - 1) // total
        slot = pos - shard * total // shards
        kept = table.drop_columns([_BUCKET, _PLACE, _KEY])
        for i in range(0, len(order), 1000):
            at = slice(i, i + 1000)
            rows = kept.take(pa.array(order[at])).combine_chunks()
            rows = rows.append_column("shard", pa.array(shard[at], pa.int32())).append_column("slot", pa.array(slot[at], pa.int64()))
            yield from rows.combine_chunks().to_batches()

    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        buckets = batch.column(batch.schema.get_field_index(_BUCKET)).to_numpy()
        cuts = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1), len(buckets)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                if held and buckets[a] != current:
                    yield from emit(held, current)
                    held = []
                current = int(buckets[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield from emit(held, current)


def _spread_equal(rows: DataFrame, buckets: int, bucket_bytes: int) -> DataFrame:
    """``rows`` with their bucket: the hash's, or for copies of a hot hash that of the hash and the copy's number."""
    columns = rows.columns
    hot = rows.groupBy(_KEY).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("bytes") * HOT_PART > bucket_bytes))
    hot = materialize(hot.select(_KEY), "shard-hot")
    own = F.pmod(_KEY, F.lit(buckets))
    if not hot.limit(1).count():
        return rows.withColumn(_BUCKET, own)
    hot = broadcast_rows(hot, BROADCAST_BUCKETS)
    copies = rows.join(hot, _KEY, "left_semi").groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias("__copies"))
    copies = materialize(copies, "shard-copies").withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)))
    spread = copies.select(*columns, F.pmod(F.xxhash64(_KEY, "__copy"), F.lit(buckets)).alias(_BUCKET))
    return rows.join(hot, _KEY, "left_anti").select(*columns, own.alias(_BUCKET)).unionByName(spread)


def write_shards(docs: DataFrame, shards: int, seed: int, path: str | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write all rows of ``docs`` (doc_id, text, ...) to ``path`` (a fresh folder of
    the shared folder if None) as Parquet in one folder per shard, each file in
    slot order, and return the written table.

    Columns: those of ``docs``, size (UTF-8 bytes of the text, none for null, plus
    16), shard (0 to ``shards`` - 1), slot (gapless from 0 per shard).  A column of
    ``docs`` that has the name of an added one is left out.  Repeated rows are all
    kept; rows equal in every column are interchangeable.  An empty table gives no
    files and an empty result.  The order follows from the rows, the seed and the
    bucket size alone, not from partitions or arrival order.
    """
    spark = docs.sparkSession
    docs = docs.select(*[c for c in docs.columns if c.lower() not in _OWN])
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    n, buckets = total["n"], max(1, -(-(total["b"] or 0) // bucket_bytes))
    path = path or scratch_path(spark, "shards")
    schema = T.StructType([*docs.withColumn("size", size).schema.fields, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    if not n:
        return spark.createDataFrame([], schema)
    hashable = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    key = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in hashable])
    rows = docs.withColumn("size", size).withColumn(_KEY, key)
    rows = _spread_equal(rows, buckets, bucket_bytes) if len(hashable) == len(docs.columns) else rows.withColumn(_BUCKET, F.pmod(_KEY, F.lit(buckets)))
    counts = materialize(rows.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("n")), "shard-buckets")
    # One row per bucket, whatever the rows: a running sum over it is small.
    before = Window.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select(_BUCKET, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(_PLACE))
    placed = rows.join(broadcast_rows(places, BROADCAST_BUCKETS), _BUCKET).select(*docs.columns, "size", _BUCKET, _PLACE, _KEY)
    # A task holds one bucket at a time, however many are its own.
    out = placed.repartition(min(buckets, TASKS), _BUCKET).sortWithinPartitions(_BUCKET, _KEY, "doc_id")
    arranged = T.StructType([*[f for f in schema.fields if f.name not in ("slot", "shard")], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    out = map_arrow(out, lambda batches: _shuffled(batches, seed, n, shards), arranged)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return spark.read.schema(schema).parquet(path)


def digest(table: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of a written table of shards."""
    return table.select(
        F.col("doc_id").cast("long").alias("doc_id"), "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
