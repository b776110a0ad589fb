"""Jaccard join of documents on word n-grams by grouped prefixes.

A text is its set of distinct word shingles.  Shingles are ordered alike
everywhere, rare ones first (by the count of their bucket), and a set of ``n`` has
the prefix of its first ``n - ceil(t n) + 1``: two sets of similarity ``t`` share a shingle of their prefixes.

1. Equal sets form one class, and classes of equal prefix and size one group, so that a
   shingle of a prefix is listed once per group.
2. Pairs of groups that share a listed shingle are filtered as groups: by their
   sizes, by where the shared shingle stands in both prefixes, by how much of the prefixes is shared at
   all, and by bit maps: every shingle flips one of ``BITS`` bits, so two maps differ in no more bits than the sets do in shingles.
3. What is left is expanded to members, which are verified on their full sets.

Members of one component need no comparison.  So each group first meets up to
``REPRESENTATIVES`` groups of the shingles it shares, and each member its group's
smallest; then all pairs of groups are made that are not in one component
yet, first by one member of either component, then by all.  No pair is lost by that: what is not compared is linked already.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servicepulse.llm.common import U, WordHashes, broadcast_rows, components, map_arrow, map_batches, shingle_hashes, text_bytes, words_of
from servicepulse.session import materialize

#: Counts of shingles are kept per bucket of their hash; the table travels in slices.
BUCKETS, SLICES = 1 << 20, 64
#: Bits of a set's map, in 64-bit words.
BITS = 512
#: Groups of one shingle that each of its others meets first.
REPRESENTATIVES = 32
#: Ids or keys (8 to 16 bytes each) that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000
#: Groups on one shingle beyond which its rows are not sent to one task.
HOT = 1024
_ROWS = 256


def batch_sets(raws: list[bytes], words: WordHashes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after the other, and where each text's begin and end."""
    split = [words_of(r) for r in raws]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    h = np.fromiter(map(words.__getitem__, chain.from_iterable(split)), np.uint64, int(sizes.sum()))
    every = shingle_hashes(h, k)  # those across two texts are not taken
    ends = np.cumsum(sizes)
    sets = [every[e - n : e - k + 1].copy() if n >= k else shingle_hashes(h[e - n : e], k) for n, e in zip(sizes.tolist(), ends.tolist())]
    for s in sets:
        s.sort()
    flat = np.concatenate(sets) if sets else h
    bounds = np.cumsum([0, *map(len, sets)])
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[bounds[:-1][bounds[:-1] < len(flat)]] = True
    return flat[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("raw"))


def _bucket(flat: np.ndarray) -> np.ndarray:
    return (flat & U(BUCKETS - 1)).astype(np.int64)


def rarity(docs: DataFrame, shingle: int) -> np.ndarray:
    """Rank (0 to 65,535, rare first) of every bucket of shingles by how many sets hold one of it.

    Counted per task and summed by Spark slice by slice.
    """
    width = BUCKETS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = WordHashes(), np.zeros(BUCKETS, np.uint32)
        for b in batches:
            for i in range(0, b.num_rows, _ROWS):
                at, c = np.unique(_bucket(batch_sets(b.column(0).slice(i, _ROWS).to_pylist(), words, shingle)[0]), return_counts=True)
                total[at] += c.astype(np.uint32)
        used = [i for i in range(SLICES) if total[i * width : (i + 1) * width].any()]
        packed = [zlib.compress(total[i * width : (i + 1) * width].tobytes(), 1) for i in used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(zlib.decompress(packed), np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], names=["slice", "counts"])

    schema = "slice int, counts binary"
    parts = map_arrow(docs.select(text_bytes(F.col("text")).alias("raw")), count, schema).repartition(SLICES, "slice")
    counts = np.zeros(BUCKETS, np.int64)
    for r in map_arrow(parts, add, schema).collect():
        counts[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
    rank = np.empty(BUCKETS, np.uint16)
    rank[np.argsort(counts, kind="stable")] = np.arange(BUCKETS) // (BUCKETS >> 16)
    return rank


def prefixes(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the set; null if it is empty), bits, group_key (digest of size and prefix), prefix (rarest first)."""
    rare = docs.sparkSession.sparkContext.broadcast(rarity(docs, shingle))

    def run(cols, state):
        words, rare = state
        flat, bounds = batch_sets(cols["raw"].to_pylist(), words, shingle)
        sizes = np.diff(bounds)
        rank = rare[_bucket(flat)]
        at = np.repeat(np.arange(len(sizes)) * BITS, sizes) + (flat >> U(64 - BITS.bit_length() + 1)).astype(np.int64)
        odd = np.bincount(at, minlength=len(sizes) * BITS) & 1
        bits = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
        set_key, group_key, prefix = [], [], [np.zeros(0, np.uint64)]
        for lo, hi in zip(bounds.tolist(), bounds[1:].tolist()):
            s, n = flat[lo:hi], hi - lo
            # Hashes ascend, so a stable order by rank settles ties by hash.
            first = s[np.argsort(rank[lo:hi], kind="stable")[: n - -(-percent * n // 100) + 1]]
            set_key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n else None)
            group_key.append(hashlib.blake2b(first.tobytes(), digest_size=16, salt=n.to_bytes(8, "little")).digest() if n else None)
            prefix.append(first if n else s)
        flat_prefix, ends = np.concatenate(prefix).view(np.int64), np.cumsum([len(x) for x in prefix])
        words_of_bits = np.arange(0, len(bits) + 1, BITS // 64)
        return {
            "doc_id": cols["doc_id"],
            "n_shingles": sizes,
            "set_key": set_key,
            "bits": pa.ListArray.from_arrays(pa.array(words_of_bits, pa.int32()), pa.array(bits)),
            "group_key": group_key,
            "prefix": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat_prefix)),
        }

    schema = "doc_id long, n_shingles long, set_key binary, bits array<long>, group_key binary, prefix array<long>"
    return map_batches(_source(docs), run, schema, lambda: (WordHashes(), rare.value), rows=_ROWS)


def full_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """id, set (sorted shingle hashes) of the rows of ``docs`` whose doc_id is in ``ids`` (id), once each."""

    def run(cols, words):
        flat, bounds = batch_sets(cols["raw"].to_pylist(), words, shingle)
        return {"id": cols["id"], "set": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.view(np.int64)))}

    src = _source(docs).withColumnRenamed("doc_id", "id").join(broadcast_rows(ids, BROADCAST_ROWS), "id", "left_semi")
    return map_batches(src, run, "id long, set array<long>", WordHashes, rows=_ROWS)


def _enough(shared: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether sets of sizes ``a`` and ``b`` that share ``shared`` are similar enough: shared / (a + b - shared) >= percent / 100."""
    return shared * (100 + percent) >= (a + b) * percent


def _alike(a: str, b: str, na: Column, nb: Column, percent: int) -> Column:
    """Whether sets of sizes ``na`` and ``nb`` may be similar by their maps of bits, columns ``a`` and ``b`` (null: they may).

    Similar sets differ in at most (100 - percent) / (100 + percent) of their sizes' sum.
    """
    differ = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))).cast("long") for i in range(BITS // 64)]
    return F.coalesce(reduce(Column.__add__, differ) * (100 + percent) <= (na + nb) * (100 - percent), F.lit(True))


def _near(na: str, nb: str, percent: int) -> Column:
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def _may_share(c: Column, na: str, nb: str, percent: int) -> Column:
    """Whether sets may be similar whose prefixes share ``c``.

    Beyond what both prefixes hold, two sets share at most what one of them has after its prefix.
    """
    rest = F.floor((F.greatest(na, nb) * percent + 99) / 100) - 1
    return _enough(c + rest, F.col(na), F.col(nb), percent)


class _Join:
    """Classes, and the label (component) of every class so far."""

    def __init__(self, docs: DataFrame, classes: DataFrame, shingle: int, percent: int):
        self.docs, self.classes, self.shingle, self.percent = docs, classes, shingle, percent
        self.labels: DataFrame | None = None

    def label(self, df: DataFrame, col: str, out: str) -> DataFrame:
        if self.labels is None:
            return df.withColumn(out, F.col(col))
        return df.join(self.labels.select(F.col("node").alias(col), F.col("label").alias("__l")), col, "left").withColumn(out, F.coalesce("__l", col)).drop("__l")

    def merge(self, links: DataFrame, name: str) -> None:
        """Merge the components that ``links`` (a, b: ids of classes) connects."""
        links = materialize(self.label(self.label(links, "a", "la"), "b", "lb").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), f"ngram-{name}-links")
        if not links.limit(1).count():
            return
        merged = components(links, f"ngram-{name}")
        if self.labels is None:
            self.labels = merged
            return
        up = merged.select(F.col("node").alias("label"), F.col("label").alias("top"))
        moved = self.labels.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
        self.labels = materialize(moved.unionByName(merged.join(self.labels, "node", "left_anti")), "ngram-labels")

    def verify(self, pairs: DataFrame, name: str) -> None:
        """Compare the full sets of ``pairs`` (a, b: ids of classes) that are not in one component yet; merge those that are similar."""
        pairs = self.label(self.label(pairs.select("a", "b").distinct(), "a", "la"), "b", "lb").where("la <> lb")
        for c in ("a", "b"):
            pairs = pairs.join(self.classes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"m{c}")), c)
        pairs = pairs.where(_near("na", "nb", self.percent) & _alike("ma", "mb", F.col("na"), F.col("nb"), self.percent))
        pairs = materialize(pairs.select("a", "b").distinct(), f"ngram-{name}")
        if not pairs.limit(1).count():
            return
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = materialize(full_sets(self.docs, ids, self.shingle), f"ngram-{name}-sets")
        for c in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("id").alias(c), F.col("set").alias(f"s{c}")), c)
        links = pairs.where(_enough(F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb"), self.percent))
        self.merge(links.select("a", "b"), name)


def _sides(df: DataFrame, c: str, id_col: str) -> DataFrame:
    """``df`` (gid, label, ``id_col``) as one side of pairs: g``c``, l``c``, ``c``."""
    return df.select(F.col("gid").alias(f"g{c}"), F.col("label").alias(f"l{c}"), F.col(id_col).alias(c))


def _inside(part: DataFrame, id_col: str) -> DataFrame:
    """a, b of one group but of two components."""
    return _sides(part, "a", id_col).join(_sides(part, "b", id_col), F.expr("ga = gb and la < lb")).select("a", "b")


def _with_state(rows: DataFrame, state: DataFrame) -> DataFrame:
    """``rows`` (key) with the ``state`` (key, size) of their key; rows of hot keys stay where they are."""
    hot = state.where(F.col("size") > HOT)
    near = rows.join(broadcast_rows(hot, BROADCAST_ROWS), "key")
    far = rows.join(broadcast_rows(hot.select("key"), BROADCAST_ROWS), "key", "left_anti").join(state.where(F.col("size") <= HOT), "key")
    return near.unionByName(far)


def _meetings(listed: DataFrame, percent: int) -> DataFrame:
    """ga, la, gb, lb of different components whose prefixes share enough.

    ``listed``: key, place, gid, n, label, bits (of a single member).  The groups of a shingle that are outside its main
    component meet all others; those of a hot shingle are dealt over several tasks.  Pairs that may be similar come once for every
    shingle that both prefixes hold, so their count is what the prefixes share.
    """
    sizes = listed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    state = sizes.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("size"), (F.sum("c") - F.max("c")).alias("outside")).where("outside > 0")
    rows = materialize(_with_state(listed, materialize(state, "ngram-state")), "ngram-open")
    parts = F.ceil(F.col("size") / HOT).cast("int")
    outer = rows.where("label <> main").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    outer = outer.select("key", "part", *(F.col(c).alias(f"{c}_") for c in ("gid", "n", "place", "label", "bits")))
    every = rows.withColumn("part", F.pmod(F.xxhash64("gid", "label"), parts).cast("int"))
    # Of a shared shingle on, two sets share at most what the shorter rest holds, and before it what the shorter beginning holds.
    most = F.least("place", "place_") + F.least(F.col("n") - F.col("place"), F.col("n_") - F.col("place_"))
    fits = _near("n", "n_", percent) & _enough(most, F.col("n"), F.col("n_"), percent) & _alike("bits", "bits_", F.col("n"), F.col("n_"), percent)
    once = (F.col("label") == F.col("main")) | (F.struct("gid", "label") < F.struct(F.col("gid_"), F.col("label_")))
    met = every.join(outer, ["key", "part"]).where((F.col("label") != F.col("label_")) & (F.col("gid") != F.col("gid_")) & once & fits)
    swap = F.col("gid") > F.col("gid_")
    pick = lambda x, y: F.when(swap, F.col(x)).otherwise(F.col(y))
    met = met.select(*(pick(f"{x}_", x).alias(f"{y}a") for x, y in zip(("gid", "label", "n"), "gln")), *(pick(x, f"{x}_").alias(f"{y}b") for x, y in zip(("gid", "label", "n"), "gln")))
    met = met.groupBy("ga", "la", "na", "gb", "lb", "nb").agg(F.count(F.lit(1)).alias("c"))
    return met.where(_may_share(F.col("c"), "na", "nb", percent)).select("ga", "la", "gb", "lb")


def similar_components(docs: DataFrame, shingle: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    Two documents link if 100 * |intersection| >= ``percent`` * |union| of their sets of ``shingle``-word
    shingles; ``component_id`` is the smallest doc_id reachable by links, itself included.  Fewer words than
    ``shingle``: the whole sequence is the one shingle.  Null, empty and blank texts have an empty
    set and link with nothing.  A row without doc_id links with nothing and has no component_id.  Rows that repeat a
    doc_id count as one document, linked through any of its texts; each row is returned.
    An empty table gives no row; other columns are ignored.
    """
    table = materialize(prefixes(docs, shingle, percent), "ngram-prefixes")
    named = table.where("set_key is not null and doc_id is not null")
    classes = named.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"), F.first("group_key").alias("group_key"))
    classes = materialize(classes, "ngram-classes")
    groups = named.groupBy("group_key").agg(F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix"), (F.min("set_key") != F.max("set_key")).alias("several"))
    groups = materialize(groups.select(F.xxhash64("group_key").alias("gid"), "n", "prefix", "several"), "ngram-groups")
    listed = groups.select("gid", "n", F.posexplode("prefix").alias("place", "key"))
    rest = F.col("n") - F.col("place")
    shape = listed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("place").alias("place"), F.min(rest).alias("rest"))
    # Most shingles that are shared at all are shared by two groups: whether these may be similar shows right here.
    two = _near("low", "high", percent) & _enough(F.col("place") + F.col("rest"), F.col("low"), F.col("high"), percent)
    shape = shape.where((F.col("size") > 2) | ((F.col("size") == 2) & two)).select("key", "size")
    listed = materialize(_with_state(listed, materialize(shape, "ngram-keys")).drop("size"), "ngram-listed")
    met = groups.where("several").select("gid").unionByName(listed.select("gid")).distinct()
    member = classes.select(F.xxhash64("group_key").alias("gid"), "id", "n", "bits").join(met, "gid")
    member = materialize(member, "ngram-members")
    join = _Join(docs, classes, shingle, percent)

    # Classes that share a document (an id repeated with different texts) belong together.
    of_doc = named.select("doc_id", "set_key").join(classes.select("set_key", "id"), "set_key").select("doc_id", "id").distinct()
    several = of_doc.groupBy("doc_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("doc_id", "lo")
    join.merge(of_doc.join(several, "doc_id").where("id <> lo").select(F.col("id").alias("a"), F.col("lo").alias("b")), "repeats")

    lead = member.groupBy("gid").agg(F.min("id").alias("lead"))
    inner = member.join(lead, "gid").where("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b"))
    turn = F.pmod("gid", F.lit(REPRESENTATIVES))
    chosen = listed.groupBy("key", turn.alias("turn")).agg(F.min("gid").alias("gb"), F.min_by("n", "gid").alias("nb"))
    star = listed.select("key", F.col("gid").alias("ga"), F.col("n").alias("na")).join(chosen, "key").where(F.col("ga") != F.col("gb")).where(_near("na", "nb", percent))
    # Which groups meet first is a choice: those that share half of what they must by these shingles alone.
    star = star.groupBy("ga", "na", "turn", "gb", "nb").agg(F.count(F.lit(1)).alias("c")).where(_may_share(F.col("c") * 2, "na", "nb", percent))
    star = star.groupBy("ga", "turn").agg(F.max_by("gb", F.struct("c", "gb")).alias("gb")).drop("turn")
    star = star.join(member.select(F.col("gid").alias("ga"), F.col("id").alias("a")), "ga").join(lead.select(F.col("gid").alias("gb"), F.col("lead").alias("b")), "gb")
    join.verify(inner.unionByName(star.select("a", "b")), "star")

    # Every pair of groups that is not in one component: one member of either component, then all of both.
    part = materialize(join.label(member.drop("n"), "id", "label"), "ngram-parts")
    of_part = part.groupBy("gid", "label").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("c"), F.first("bits").alias("bits"))
    owners = of_part.select(F.col("gid").alias("owner"), "label", F.when(F.col("c") == 1, F.col("bits")).alias("bits"))
    rows = listed.withColumnRenamed("gid", "owner").join(owners, "owner").withColumnRenamed("owner", "gid")
    pairs = materialize(_meetings(rows, percent), "ngram-pairs")
    mixed = part.groupBy("gid").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("gid")
    leads = pairs.join(_sides(of_part, "a", "lead"), ["ga", "la"]).join(_sides(of_part, "b", "lead"), ["gb", "lb"])
    join.verify(leads.select("a", "b").unionByName(_inside(of_part.join(mixed, "gid"), "lead")), "leads")
    more = pairs.join(_sides(of_part, "a", "c"), ["ga", "la"]).join(_sides(of_part, "b", "c"), ["gb", "lb"]).where("a > 1 or b > 1").drop("a", "b")
    members = more.join(_sides(part, "a", "id"), ["ga", "la"]).join(_sides(part, "b", "id"), ["gb", "lb"])
    join.verify(members.select("a", "b").unionByName(_inside(part.join(mixed, "gid"), "id")), "members")

    # Back to the rows: a label is the smallest doc_id of its component.
    of_class = join.label(classes.select("set_key", "id"), "id", "component_id").select("set_key", "component_id")
    of_doc = named.select("doc_id", "set_key").join(of_class, "set_key").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = table.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left")
    return out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
