"""Near-duplicate documents by an LSH forest over MinHash signatures.

Every text becomes its set of distinct word shingles.  Equal sets form one
class; a class has a signature of ``TREES * DEPTH`` MinHash values.  Tree ``i``
of the forest orders the classes by the signature rotated to start at value
``i * DEPTH``; a region is a run of classes that share a prefix of that order.
Prefixes start at ``DEPTH`` values, where a pair of similarity 0.8 misses all
``TREES`` trees with probability 5e-8, and a region is read deeper only where
it is crowded and holds classes that are not yet linked.  Candidates are

1. the neighbour at the head of a class's region (its smallest id), in the
   tree whose head it meets most often;
2. in every region that then still holds several components: each class
   outside the region's largest component with all classes of other
   components, if no more than ``CROWD`` are outside.  A more crowded region is
   split by the next ``DEPTH`` values of its order and its parts are treated
   likewise, heads first, down to equal signatures;
3. what that leaves of the crowded regions, without loss: sets of similarity
   ``s`` share one of their rarest shingles, namely of the first
   ``n - ceil(s n) + 1`` in an order common to all, so classes that met a crowded
   region meet again by each of these, unless size or position rule it out.

Pairs whose signatures agree in fewer than ``LEAST_EQUAL`` values are no
candidates; every other is confirmed on the full shingle sets.  Within a
region the sets are compared by what they hold more or less than a common
pivot, which for near copies is little: two sets differ in exactly what is in
one of the two differences and not in the other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servicepulse.llm.common import U, WordHashes, broadcast_rows, components, map_arrow, map_batches, mix64, shingle_hashes, text_bytes, words_of
from servicepulse.session import materialize

TREES, DEPTH = 32, 4
WIDTH = TREES * DEPTH
#: Classes outside the largest component that a region may have, and classes of a region compared in one task.
CROWD, SPLIT = 512, 1024
#: A pair of similarity 0.8 agrees in fewer of 128 values with probability below 1e-6.
LEAST_EQUAL = 78
#: Ids (8 bytes each) that may be broadcast; beyond it the join shuffles.
BROADCAST_IDS = 2_000_000
_BLOCK = 4096
#: Shingles are ordered by how often their bucket occurs.
BUCKETS = 1 << 20


def _seeds() -> np.ndarray:
    x = mix64(np.arange(1, 2 * WIDTH + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    return np.stack([x[:WIDTH] | U(1), x[WIDTH:]])


def signature(s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits each) of a set of 64-bit hashes; long sets in blocks."""
    low = None
    for i in range(0, len(s), _BLOCK):
        m = ((s[i : i + _BLOCK, None] * seeds[0] + seeds[1]) >> U(32)).min(axis=0)
        low = m if low is None else np.minimum(low, m)
    return low.astype(np.uint32).view(np.int32)


def _sets(raw: pa.Array, words: WordHashes, k: int):
    for b in raw.to_pylist():
        yield np.unique(shingle_hashes(words.of(words_of(b)), k))


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the set; null if it is empty), sig."""
    import hashlib

    def run(cols, state):
        words, seeds = state
        n, key, sig = [], [], []
        for s in _sets(cols["raw"], words, shingle):
            n.append(len(s))
            key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sig.append(signature(s, seeds) if len(s) else None)
        flat = np.concatenate([x for x in sig if x is not None] or [np.zeros(0, np.int32)])
        ends = np.cumsum([0] + [0 if x is None else WIDTH for x in sig])
        return {"doc_id": cols["doc_id"], "n_shingles": n, "set_key": key, "sig": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))}

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("raw"))
    return map_batches(src, run, "doc_id long, n_shingles long, set_key binary, sig array<int>", lambda: (WordHashes(), _seeds()))


def _full_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """id, set (sorted distinct shingle hashes) of the documents in ``ids`` (id)."""

    def run(cols, words):
        sets = [s.view(np.int64) for s in _sets(cols["raw"], words, shingle)]
        ends = np.cumsum([0] + [len(s) for s in sets])
        return {"id": cols["id"], "set": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets), pa.int64()))}

    src = docs.select(F.col("doc_id").cast("long").alias("id"), text_bytes(F.col("text")).alias("raw")).join(broadcast_rows(ids, BROADCAST_IDS), "id", "left_semi")
    return map_batches(src, run, "id long, set array<long>", WordHashes)


class _Links:
    """Confirmed links so far: a label per class, and the way to confirm more."""

    def __init__(self, classes: DataFrame, sets: DataFrame, percent: int):
        self.classes, self.sets, self.percent = classes, sets, percent
        self.labels: DataFrame | None = None

    def label(self, df: DataFrame, col: str, out: str) -> DataFrame:
        if self.labels is None:
            return df.withColumn(out, F.col(col))
        return df.join(self.labels.select(F.col("node").alias(col), F.col("label").alias("_l")), col, "left").withColumn(out, F.coalesce("_l", col)).drop("_l")

    def confirm(self, pairs: DataFrame, name: str) -> None:
        """Take (a, b, sure) pairs, confirm those whose sets are similar (sure: known to be), merge their components."""
        pairs = pairs.groupBy("a", "b").agg(F.bool_or("sure").alias("sure"))
        pairs = self.label(self.label(pairs, "a", "la"), "b", "lb").where("la <> lb")
        sig = self.classes.select("id", "n", "sig")
        for c in ("a", "b"):
            pairs = pairs.join(sig.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}")), c)
            if c == "b":
                pairs = pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent)
        alike = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
        pairs = materialize(pairs.where(F.col("sure") | (alike >= LEAST_EQUAL)).select("a", "b", "sure", "la", "lb", "na", "nb"), f"neardup-{name}")
        sure, pairs = pairs.where("sure").select(F.col("la").alias("a"), F.col("lb").alias("b")), pairs.where("not sure")
        for c in ("a", "b"):
            pairs = pairs.join(self.sets.select(F.col("id").alias(c), F.col("set").alias(f"set{c}")), c)
        shared = F.size(F.array_intersect("seta", "setb"))
        links = pairs.where(shared * 100 >= (F.size("seta") + F.size("setb") - shared) * self.percent).select(F.col("la").alias("a"), F.col("lb").alias("b"))
        links = materialize(links.unionByName(sure).distinct(), f"neardup-{name}-links")
        self.merge(links, name)

    def merge(self, links: DataFrame, name: str) -> None:
        """Merge the components that ``links`` (a, b: labels) connects."""
        if not links.limit(1).count():
            return
        merged = components(links, f"neardup-{name}")
        up = merged.select(F.col("node").alias("label"), F.col("label").alias("top"))
        if self.labels is None:
            self.labels = merged
            return
        # Labels that were merged now, and nodes that had no link before.
        moved = self.labels.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
        fresh = merged.join(self.labels.select("node"), "node", "left_anti")
        self.labels = materialize(moved.unionByName(fresh), "neardup-labels")


def _pairs(heads: DataFrame) -> DataFrame:
    return heads.select(F.col("id").alias("a"), F.col("head").alias("b"), F.lit(False).alias("sure"))


def _differences(regions: DataFrame, sets: DataFrame) -> DataFrame:
    """id, pivot, delta: a class's set against that of the component its regions mostly belong to.

    delta is null where it is more than half of the set: such a set is compared whole.
    """
    votes = regions.groupBy("id", "main").agg(F.count(F.lit(1)).alias("n"))
    pivots = votes.groupBy("id").agg(F.max_by("main", F.struct("n", -F.col("main"))).alias("pivot"))
    both = pivots.join(sets, "id").join(sets.select(F.col("id").alias("pivot"), F.col("set").alias("base")), "pivot")
    delta = F.concat(F.array_except("set", "base"), F.array_except("base", "set"))
    both = both.select("id", "pivot", F.size("set").alias("own"), delta.alias("delta")).groupBy("id").agg(F.first("pivot").alias("pivot"), F.first("delta").alias("delta"), F.min("own").alias("own"), F.count(F.lit(1)).alias("sets"))
    # An id that repeats with different texts has several sets; it is compared whole too.
    return both.select("id", "pivot", F.when((F.col("sets") == 1) & (F.size("delta") * 2 <= F.col("own")), F.col("delta")).alias("delta"))


def _candidates(regions: DataFrame, classes: DataFrame, sets: DataFrame, level: int, percent: int) -> DataFrame:
    """(a, b, sure) of different components that share a region and have similar signatures.

    Pairs whose differences from one pivot are known are decided here: those
    that are similar enough come out as sure, the others not at all.

    The classes outside a region's main component are held in memory, all others
    stream past them; a large region is dealt over several tasks, each with all
    that are outside.  A pair that shares several regions is given once, in the
    first tree.
    """
    outside = F.col("label") != F.col("main")
    parts = F.ceil(F.col("size") / SPLIT).cast("int")
    own = F.array(F.pmod(F.xxhash64("id"), parts).cast("int"))
    trees = regions.groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, tree)")).alias("trees"))
    rows = regions.withColumn("outside", outside).withColumn("part", F.explode(F.when(outside, F.sequence(F.lit(0), parts - 1)).otherwise(own)))
    rows = rows.join(classes.select("id", "n", "sig"), "id").join(trees, "id").join(_differences(regions, sets), "id", "left")
    rows = rows.select("key", "part", "outside", "tree", "id", "label", "n", "trees", F.coalesce("pivot", F.lit(0)).alias("pivot"), "delta", "sig")
    rows = rows.repartition("key", "part").sortWithinPartitions("key", "part", F.desc("outside"), "id")

    def compare(x: dict, y: dict, upper: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of positions that are candidates, not given by an earlier tree, and whether they are sure."""
        i, j = np.nonzero((x["label"][:, None] != y["label"][None]) & (np.minimum(x["n"][:, None], y["n"][None]) * 100 >= np.maximum(x["n"][:, None], y["n"][None]) * percent))
        if upper:
            i, j = i[i < j], j[i < j]
        if len(i):
            same = x["sig"][i] == y["sig"][j]
            keep = same.sum(axis=1) >= LEAST_EQUAL
            i, j, same = i[keep], j[keep], same[keep].reshape(-1, TREES, DEPTH).all(axis=2)
            met = same.copy()
            for k in range(1, level + 1):
                met &= np.roll(same, -k, axis=1)
            open_ = (x["trees"][i][:, None] >> np.arange(TREES)) & 1 == 1
            first = (met & open_).argmax(axis=1) == x["tree"][i]
            i, j = i[first], j[first]
        sure = np.zeros(len(i), bool)
        known = np.flatnonzero(x["pivot"][i] == y["pivot"][j]) if len(i) else []
        keep = np.ones(len(i), bool)
        for k in known:
            a, b = x["delta"][i[k]], y["delta"][j[k]]
            if a is not None and b is not None:
                total = int(x["n"][i[k]] + y["n"][j[k]])
                shared = (total - len(a ^ b)) // 2
                sure[k] = keep[k] = shared * 100 >= percent * (total - shared)
        return i[keep], j[keep], sure[keep]

    def run(batches):
        held, at = None, None
        for batch in batches:
            key, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cols = {n: batch.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(batch.schema.names) if n not in ("sig", "delta")}
            cols["sig"] = batch.column("sig").flatten().to_numpy().reshape(-1, WIDTH)
            cols["delta"] = np.empty(len(key), object)
            cols["delta"][:] = [d if d is None else frozenset(d) for d in batch.column("delta").to_pylist()]
            change = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (cols["outside"][1:] != cols["outside"][:-1])) + 1
            cuts = [0, *change.tolist(), len(key)]
            out_a, out_b, out_sure = [], [], []
            for lo, hi in zip(cuts, cuts[1:]):
                if (key[lo], part[lo]) != at:
                    held, at = None, (key[lo], part[lo])
                for k in range(lo, hi, 256):
                    own = {n: c[k : min(k + 256, hi)] for n, c in cols.items()}
                    for other, upper in ((held, False), (own, True)) if own["outside"][0] else ((held, False),):
                        # Pairs of two that are outside stand in every part: the first gives them.
                        if other is not None and (part[lo] == 0 or not own["outside"][0]):
                            i, j, sure = compare(own, other, upper)
                            x, y = own["id"][i], other["id"][j]
                            out_a.append(np.maximum(x, y))
                            out_b.append(np.minimum(x, y))
                            out_sure.append(sure)
                    if own["outside"][0]:
                        held = own if held is None else {n: np.concatenate([held[n], own[n]]) for n in held}
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b)), pa.array(np.concatenate(out_sure))], names=["a", "b", "sure"])

    return map_arrow(rows, run, "a long, b long, sure boolean")


def _rarest(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """key, id, n, place: the shingles by which a class of ``crowd`` (id) must meet any that is similar.

    Any order common to all classes would do; by bucket counts the rare come first.
    """
    own = sets.join(broadcast_rows(crowd, BROADCAST_IDS), "id", "left_semi")
    bucket = F.col("key").bitwiseAND(BUCKETS - 1).cast("int")
    counts = own.select(F.explode("set").alias("key")).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("c")).toArrow()
    often = np.zeros(BUCKETS, np.int64)
    often[counts["bucket"].to_numpy()] = counts["c"].to_numpy()
    shared = crowd.sparkSession.sparkContext.broadcast(often)

    def run(cols, often):
        key, owner, size, place = [], [], [], []
        for i, s in zip(cols["id"].to_pylist(), cols["set"]):
            s = np.asarray(s.values)
            c = often[s & (BUCKETS - 1)]
            first = len(s) - -(-percent * len(s) // 100) + 1
            first = np.lexsort((s, c))[:first]
            at = np.flatnonzero(c[first] > 1)  # what occurs once meets nothing
            key.append(s[first[at]])
            place.append(at)
            owner.append(np.full(len(at), i, np.int64))
            size.append(np.full(len(at), len(s), np.int64))
        return {n: pa.array(np.concatenate(x)) for n, x in (("key", key), ("id", owner), ("n", size), ("place", place))}

    return map_batches(own, run, "key long, id long, n long, place long", lambda: shared.value)


def _meetings(rarest: DataFrame, links: _Links, percent: int) -> DataFrame:
    """(a, b, sure) of different components that share one of their rarest shingles; large groups are dealt over several tasks."""
    rows = materialize(links.label(rarest, "id", "label"), "neardup-rarest")
    sizes = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    shape = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("size"), (F.sum("n") - F.max("n")).alias("outside")).where("outside > 0")
    rows = rows.join(shape.select("key", "main", F.ceil(F.col("size") / SPLIT).cast("int").alias("parts")), "key")
    outer = rows.where("label <> main").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    outer = outer.select("key", "part", *(F.col(c).alias(f"{c}_") for c in ("id", "label", "n", "place")))
    every = rows.withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    # Enough must be left of both orders after the first shingle that two share.
    left = 1 + F.least(F.col("n") - F.col("place"), F.col("n_") - F.col("place_")) - 1
    pairs = every.join(outer, ["key", "part"]).where("label <> label_").where(F.least("n", "n_") * 100 >= F.greatest("n", "n_") * percent)
    pairs = pairs.where(left * (100 + percent) >= (F.col("n") + F.col("n_")) * percent)
    return pairs.select(F.greatest("id", "id_").alias("a"), F.least("id", "id_").alias("b"), F.lit(False).alias("sure"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Two documents are linked if 100 * |intersection| >= ``percent`` * |union| of
    their sets of ``shingle``-word shingles; ``component_id`` is the smallest
    doc_id reachable by links.  Fewer words than ``shingle``: the whole sequence
    is the one shingle.  Null, empty or blank texts have an empty set and stay
    alone.  A row without doc_id stays alone too (component_id null, kept true).
    Rows that repeat a doc_id count as one document: linked through any of its
    texts; each row is returned.  Other columns are ignored.
    """
    table = materialize(signatures(docs, shingle), "neardup-signatures")
    named = table.where("set_key is not null and doc_id is not null")
    classes = named.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = materialize(classes, "neardup-classes")
    rotated = lambda level: F.slice(F.concat("sig", "sig"), F.col("tree") * DEPTH + 1 + level * DEPTH, DEPTH)
    keys = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.slice("sig", t * DEPTH + 1, DEPTH)))
    rows = classes.select("id", F.posexplode(keys).alias("tree", "key"))
    heads = rows.groupBy("key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    forest = materialize(rows.join(heads, "key").select("tree", "key", "id", "head", "size"), "neardup-forest")
    sets = materialize(_full_sets(docs, forest.select("id").distinct(), shingle), "neardup-sets")
    links = _Links(classes, sets, percent)

    # Classes that share a document (an id repeated with different texts) belong together.
    of_doc = named.select("doc_id", "set_key").join(classes.select("set_key", "id"), "set_key").select("doc_id", "id")
    several = of_doc.groupBy("doc_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("doc_id", "lo")
    links.merge(materialize(of_doc.join(several, "doc_id").where("id <> lo").select(F.col("id").alias("a"), F.col("lo").alias("b")).distinct(), "neardup-repeats"), "repeats")

    met = forest.where("id <> head").groupBy("id", "head").agg(F.count(F.lit(1)).alias("trees"))
    first = met.groupBy("id").agg(F.min_by("head", F.struct(-F.col("trees"), F.col("head"))).alias("head"))
    links.confirm(_pairs(first), "head")

    regions, level, crowd = forest.select("tree", "key", "id"), 0, None
    while True:
        # Regions that still hold several components, and how many of their classes are outside the largest.
        mixed = links.label(regions, "id", "label")
        sizes = mixed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
        shape = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("size"), (F.sum("n") - F.max("n")).alias("outside")).where("outside > 0")
        regions = materialize(mixed.join(shape, "key"), "neardup-open")
        if not regions.limit(1).count():
            break
        links.confirm(_candidates(regions.where(F.col("outside") <= CROWD), classes, sets, level, percent), f"region-{level}")
        level += 1
        crowded = regions.where(F.col("outside") > CROWD).select("tree", "key", "id")
        if level == TREES or not crowded.limit(1).count():
            break
        if crowd is None:
            crowd = materialize(crowded.select("id").distinct(), "neardup-crowd")
        # The next values of each order split what is crowded.
        deeper = crowded.join(classes.select("id", "sig"), "id").select("tree", "id", F.xxhash64("key", rotated(level)).alias("key"))
        heads = deeper.groupBy("key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
        regions = materialize(deeper.join(heads, "key").select("tree", "key", "id", "head"), "neardup-deeper")
        links.confirm(_pairs(regions.where("id <> head")), f"deeper-{level}")
        regions = regions.drop("head")

    if crowd is not None:
        links.confirm(_meetings(_rarest(crowd, sets, percent), links, percent), "rarest")

    # Back to the rows: class by set, then component by class.
    of_class = links.label(classes.select("set_key", "id"), "id", "component_id").select("set_key", "component_id")
    of_doc = named.select("doc_id", "set_key").join(of_class, "set_key").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = table.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
