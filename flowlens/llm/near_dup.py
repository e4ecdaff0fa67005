"""Operator 6: MinHash near-duplicates with odd sketches.

A document's set is its distinct shingles of five lower-cased words. ``SAMPLES`` MinHash values per set give
``BANDS`` x ``ROWS`` band hashes for candidate search and an odd sketch: every (sample, value) pair flips one bit of a parity
bitmap, so the XOR of two bitmaps has a set bit count that estimates a high similarity closely. A pair at the threshold is
missed by all bands with a chance of about (1 - 0.85**6)**40 = 6e-9, at a threshold of 0.80 of (1 - 0.80**6)**40 = 5e-6.

Equal sets are one class from the start (a hot text costs one row); two hashes of 64 bits over the whole
set tell classes apart, and where two classes agree in the first, both are named anew by the two together. Work on pairs
never expands a bucket:

1. each class is held against the smallest class of each of its buckets, sketch first, then the full sets;
2. the links found give components; only buckets in which two components still meet go on. A bucket's largest component needs
   no test against itself: the other classes, its strays, are cut into blocks of bounded size that meet each other and the
   blocks of the largest component. A block pair tests the pairs of different components by sketch, the likely ones on full
   sets, and returns at most a spanning forest. A pair is tested in its first common band only.

So every pair that shares a bucket is either in one component already or tested.

Defined cases: null and empty texts and texts without words have an empty set, are linked with nothing and stay; with fewer
than five words the whole sequence is one shingle; repeated rows are one class; a null doc_id counts as the largest and is
returned as null; an empty table gives no rows; other input columns are not read (``keep_one`` carries them along).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm import repeats
from flowlens.llm import textcore as tc
from flowlens.llm.graph import components
from flowlens.llm.joins import salted
from flowlens.llm.stages import materialize

SHINGLE = 5
BANDS, ROWS, SAMPLES = 40, 6, 256
SKETCH_LONGS = 16
#: Links need 100 * intersection >= percent * union; op6's contract names this one.
PERCENT = 85
#: Full sets aren't compared when the estimated similarity is more than so many percent under the threshold: 5.6 standard
#: deviations at 85, 4.9 at 80.
MARGIN = 13
BLOCK = 512

_rng = np.random.default_rng(6)
_A = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each document, end to end, and each document's first one."""
    low = tc.LOWER[data]
    starts, ends, wo = tc.words(low, off)
    codes = tc.span_hash(low, starts, ends)
    n = np.diff(wo)
    at, own = tc.doc_starts(wo, SHINGLE)
    h = tc.mix(tc.window_hash(codes, SHINGLE)[at], SHINGLE)
    parts, owns = [h], [own]
    for size in range(1, SHINGLE):
        short = np.flatnonzero(n == size)
        if len(short):
            parts.append(tc.mix(tc.window_hash(codes, size)[wo[:-1][short]], size))
            owns.append(short)
    h, own = np.concatenate(parts), np.concatenate(owns)
    if len(parts) > 1:
        order = np.argsort(own, kind="stable")
        h, own = h[order], own[order]
    so = np.searchsorted(own, np.arange(len(n) + 1))
    for a, b in zip(so[:-1], so[1:], strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[new], np.concatenate([[0], np.cumsum(new)])[so]


def _names(h: np.ndarray, so: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set (node, check)."""
    zero = np.zeros(1, np.uint64)  # typed: joined with a plain 0 the sums would turn into floats
    out = []
    for seed in (11, 12):
        total = np.concatenate([zero, np.cumsum(tc.mix(h, seed))])
        out.append(tc.mix(total[so[1:]] - total[so[:-1]] + np.diff(so).astype(np.uint64), seed + 2).view(np.int64))
    return out[0], out[1]


def signatures(h: np.ndarray, so: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (documents x BANDS) and odd sketches (documents x SKETCH_LONGS) of non-empty sets."""
    docs = len(so) - 1
    low = np.empty((docs, SAMPLES), np.uint64)
    g = np.empty(len(h), np.uint64)
    for i in range(SAMPLES):
        np.bitwise_xor(h, _B[i], out=g)
        np.multiply(g, _A[i], out=g)
        low[:, i] = np.minimum.reduceat(g, so[:-1])
    bands = np.zeros((docs, BANDS), np.uint64)
    for r in range(ROWS):
        bands = tc.mix(bands ^ low[:, r:BANDS * ROWS:ROWS], 20 + r)
    bands = tc.mix(bands ^ np.arange(BANDS, dtype=np.uint64)[None, :], 30)
    bits = SKETCH_LONGS * 64
    at = (tc.mix(low ^ np.arange(SAMPLES, dtype=np.uint64)[None, :], 31) % np.uint64(bits)).astype(np.int64)
    odd = np.zeros((docs, bits), np.uint8)
    rows = np.arange(docs)
    for i in range(SAMPLES):
        odd[rows, at[:, i]] ^= 1
    return bands.view(np.int64), np.packbits(odd, axis=1).view(np.int64)


def _lists(x: np.ndarray, have: np.ndarray) -> pa.Array:
    """A long-array column: one row of x for each true entry, empty lists elsewhere."""
    off = np.concatenate([[0], np.cumsum(np.where(have, x.shape[1], 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(x.reshape(-1)))


def features(docs: DataFrame) -> DataFrame:
    """(id, key, node, check, n_shingles, bands, sketch) of every row; node and check null for empty sets. No shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in tc.slices(batches, "__text", 1 << 20):
            h, so = shingles(data, off)
            n = np.diff(so)
            have = n > 0
            full = np.concatenate([so[:-1][have], so[-1:]])
            node, check = _names(h, so)
            bands, sketch = signatures(h, full) if have.any() else (np.zeros((0, BANDS), np.int64), np.zeros((0, SKETCH_LONGS), np.int64))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(node, mask=~have), pa.array(check, mask=~have), pa.array(n.astype(np.int64)),
                 _lists(bands, have), _lists(sketch, have)], ["id", "key", "node", "check", "n_shingles", "bands", "sketch"])

    return repeats.keyed(docs).select("id", "key", "__text").mapInArrow(
        run, "id long, key long, node long, check long, n_shingles long, bands array<long>, sketch array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    """(node, check, set) of texts given as (__text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, off in tc.slices(batches, "__text", 1 << 20):
            h, so = shingles(data, off)
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, _names(h, so)),
                 pa.ListArray.from_arrays(pa.array(so.astype(np.int32)), pa.array(h.view(np.int64)))], ["node", "check", "set"])

    return rows.mapInArrow(run, "node long, check long, set array<long>")


def clashes(found: DataFrame) -> DataFrame:
    """(node, clash: true) of the nodes that different sets share."""
    both = found.groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b"))
    return materialize(both.where("a <> b").select("node", F.lit(True).alias("clash")), "near-clashes")


def told_apart(rows: DataFrame, clash: DataFrame) -> DataFrame:
    """``rows`` (node, check, ...) without ``check``, nodes of different sets named by both hashes."""
    x = rows.join(clash, "node", "left")
    return x.withColumn("node", F.when(F.col("clash"), F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("check", "clash")


def estimate(a: Column, b: Column) -> Column:
    """Similarity estimated from two odd sketches."""
    bits = SKETCH_LONGS * 64
    flips = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, SKETCH_LONGS)), F.bit_count(a[0].bitwiseXOR(b[0])))
    return F.when(flips * 2 >= bits, F.lit(0.0)).otherwise(1 + F.log(1 - 2 * flips / bits) * (bits / 2) / (2 * SAMPLES))


def loose(percent: int) -> float:
    """Estimated similarity below which full sets aren't compared."""
    return (percent - MARGIN) / 100


def _near(na: Column, nb: Column, percent: int) -> Column:
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that are links, checked on full sets."""
    side = classes.select("node", "n", "sketch")
    x = (pairs.join(side.toDF("u", "nu", "su"), "u").join(side.toDF("v", "nv", "sv"), "v")
         .where(_near(F.col("nu"), F.col("nv"), percent) & (estimate(F.col("su"), F.col("sv")) >= loose(percent))).select("u", "v"))
    x = x.join(sets.toDF("u", "su"), "u").join(sets.toDF("v", "sv"), "v")
    both = F.size(F.array_intersect("su", "sv"))
    return x.where(100 * both >= percent * (F.size("su") + F.size("sv") - both)).select("u", "v")


def _blocks(percent: int) -> Callable:
    """Links between different components of two blocks of one bucket: at most a spanning forest."""
    def run(table: pa.Table) -> pa.Table:
        node, comp, n = (table[c].to_numpy() for c in ("node", "comp", "n"))
        bucket, left, right = table["bucket"][0].as_py(), table["i"][0].as_py(), table["j"][0].as_py()
        chunk = table["chunk"].to_numpy()
        sketch = np.array(table["sketch"].to_pylist(), np.int64).view(np.uint64)
        bands = np.array(table["bands"].to_pylist(), np.int64)
        sets = [None] * len(node)
        a, b = np.flatnonzero(chunk == left), np.flatnonzero(chunk == right)
        band = int(np.argmax(bands[0] == bucket))
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        bits = SKETCH_LONGS * 64
        most = bits / 2 * (1 - np.exp(-2 * (1 - loose(percent)) * 2 * SAMPLES / bits))
        us, vs = [], []
        for i in a:
            flips = np.bitwise_count(sketch[b] ^ sketch[i]).sum(1)
            ok = (flips <= most) & (comp[b] != comp[i]) & (100 * np.minimum(n[b], n[i]) >= percent * np.maximum(n[b], n[i]))
            if left == right:
                ok &= b > i
            ok[ok] = ~(bands[b[ok], :band] == bands[i, :band]).any(1)
            near = b[ok]
            for j in near[np.argsort(flips[ok], kind="stable")]:
                x, y = root(int(comp[i])), root(int(comp[j]))
                if x == y:
                    continue
                for k in (i, j):
                    if sets[k] is None:
                        sets[k] = table["set"][int(k)].values.to_numpy()
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (n[i] + n[j] - both):
                    parent[x] = y
                    us.append(node[i])
                    vs.append(node[j])
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})
    return run


def block_rows(rows: DataFrame) -> DataFrame:
    """(bucket, i, j, chunk, node, comp): the classes of each block pair (i, j) to test, from (bucket, node, comp).

    Buckets of one component give none. The strays of a bucket (all but its largest component) are blocks 0, 1, ..., the largest
    component's follow; a class of the latter is copied once for each block of strays, not once for each block of the bucket.
    """
    counts = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("size"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    per = per.where(F.col("size") > F.col("most.n")).select(
        "bucket", F.col("most.comp").alias("main"), blocks(F.col("size") - F.col("most.n")).alias("strays"),
        blocks(F.col("most.n")).alias("mains"))
    deal = lambda n: F.pmod(F.xxhash64("node", "bucket"), F.col(n)).cast("int")
    x = rows.join(per, "bucket").withColumn("inside", F.col("comp") == F.col("main"))
    x = x.withColumn("chunk", F.when(F.col("inside"), F.col("strays") + deal("mains")).otherwise(deal("strays")))
    last = F.col("strays") - 1 + F.when(F.col("inside"), 0).otherwise(F.col("mains"))
    x = x.withColumn("x", F.explode(F.sequence(F.lit(0), last)))
    return x.select("bucket", F.least("chunk", "x").alias("i"), F.greatest("chunk", "x").alias("j"), "chunk", "node", "comp")


def links(docs: DataFrame, found: DataFrame, clash: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(classes, components): classes (node, rep: smallest id) and, for linked classes, (node, comp)."""
    have = found.where("node is not null")
    classes = materialize(have.groupBy("node").agg(
        F.min("id").alias("rep"), F.min_by("key", "id").alias("rep_key"), F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "near-classes")
    rows = classes.select("node", F.explode("bands").alias("bucket"))
    several = rows.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("other"))
    several = several.where("pivot <> other").select("bucket", "pivot")
    members = materialize(rows.join(several, "bucket"), "near-members")
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select(
        F.col("rep").alias("id"), F.col("rep_key").alias("key"))
    texts = repeats.keyed(docs).join(wanted, ["id", "key"], "left_semi").select("__text")
    sets = materialize(told_apart(_sets(texts), clash).groupBy("node").agg(F.first("set").alias("set")), "near-sets")
    star = members.where("node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
    first = materialize(_verified(star, classes, sets, percent), "near-links")
    comps = components(first)
    open_rows = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    todo = block_rows(open_rows.select("bucket", "node", "comp"))
    todo = todo.join(classes.select("node", "n", "bands", "sketch"), "node").join(sets, "node")
    second = materialize(todo.groupBy("bucket", "i", "j").applyInArrow(_blocks(percent), "u long, v long"), "near-more-links")
    if not second.isEmpty():
        comps = components(first.unionByName(second))
    return classes.select("node", "rep", "rep_key"), comps


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, key, n_shingles, component_id, first: whether the row's (id, key) is its component's smallest) of every row."""
    found = materialize(features(docs), "near-features")
    clash = clashes(found)
    found = told_apart(found, clash)
    classes, comps = links(docs, found, clash, percent)
    named = materialize(classes.join(comps, "node", "left").select("node", "rep", "rep_key", "comp"), "near-named")
    linked = named.where("comp is not null")
    least = linked.groupBy("comp").agg(F.min(F.struct("rep", "rep_key")).alias("least"))
    # a component that holds much of the corpus is many tasks; an unlinked class is its own component
    by_node = salted(linked.select("node", "comp"), least, "comp", "node").select("node", "least").unionByName(
        named.where("comp is null").select("node", F.struct("rep", "rep_key").alias("least")))
    rows = found.select("id", "key", "node", "n_shingles").join(by_node, "node", "left")
    return rows.select("id", "key", "n_shingles", F.coalesce(F.col("least.rep"), F.col("id")).alias("component_id"),
                       (F.col("least").isNull() | ((F.col("least.rep") == F.col("id")) & (F.col("least.rep_key") == F.col("key")))
                        ).alias("first"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents with one row left of each group: the smallest doc_id's. All columns are kept."""
    cols = docs.columns
    stay = near_duplicates(docs, percent).where("first").select("id", "key").distinct()
    rows = repeats.keyed(docs, tuple(cols)).join(stay, ["id", "key"], "left_semi")
    # repeated rows share id and key; those with an empty set are linked with nothing and all stay
    has_words = F.col("__text").rlike("[^\\x20\\x09-\\x0D]")
    rows = rows.where(~F.coalesce(has_words, F.lit(False))).unionByName(rows.where(has_words).dropDuplicates(["id", "key"]))
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])


def op6_near_dup(docs: DataFrame) -> DataFrame:
    """The contract's digest: set size, component and whether the document is its component's smallest."""
    back = lambda c: F.when(F.col(c) != repeats.NULL_ID, F.col(c))
    return near_duplicates(docs).select(back("id").alias("doc_id"), "n_shingles", back("component_id").alias("component_id"),
                                        (F.col("id") == F.col("component_id")).alias("kept"))
