"""Operator 12: SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has one bit for each bit position that is set in over half of its shingles' XXH64 hashes. Every bit
position gets a non-zero code of ``RADIUS + 1`` bits; table v (one for each non-zero code v) compares the bits whose code has odd
overlap with v. Two fingerprints that differ in at most ``RADIUS`` bits collide in some table for sure: their differing bits give
at most ``RADIUS`` linear equations in ``RADIUS + 1`` unknowns over GF(2), so a non-zero v solves them all, and table v looks at
none of those bits.

Equal fingerprints are one class from the start. Work on pairs never expands a bucket:

1. each class is held against the smallest class of each of its buckets;
2. a class takes the smallest class it is linked with as its label; buckets in which two labels still meet go on. A bucket of at
   most ``BLOCK`` classes is one group, which tests pairs of different labels and returns at most a spanning forest. A larger one is split by the tables of the next, independently drawn code, under
   which every pair within the radius collides again;
3. what is larger than ``BLOCK`` after ``LEVELS`` codes is cut into blocks, and every two blocks meet in one group.

So every pair within the radius has one label already or is tested, whatever the sizes of the buckets. All links together give the
components.

Defined cases: null and empty texts and texts without words have fingerprint zero and are linked like any other; with fewer than
three words the whole sequence is the one shingle; repeated rows are one class; a null doc_id counts as the largest and is returned
as null; an empty table gives no rows; other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm import textcore as tc
from flowlens.llm.graph import components
from flowlens.llm.joins import salted
from flowlens.llm.repeats import NULL_ID
from flowlens.llm.stages import materialize

SHINGLE, SEED = 3, 42
RADIUS = 3
BLOCK, LEVELS = 4096, 3
#: Shingles of up to so many bytes are hashed together, longer ones one by one.
_LONG = 128
_VOTES = 1 << 17

# The five primes of XXH64.
_P1, _P2, _P3 = tc.U(0x9E3779B185EBCA87), tc.U(0xC2B2AE3D27D4EB4F), tc.U(0x165667B19E3779F9)
_P4, _P5 = tc.U(0x85EBCA77C2B2AE63), tc.U(0x27D4EB2F165667C5)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << tc.U(r)) | (x >> tc.U(64 - r))


def _step(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def _equal_length(rows: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each row of a byte matrix."""
    m, n = rows.shape
    s = tc.U(seed)
    whole = rows[:, :n // 8 * 8].copy().view("<u8")
    lanes, at = n // 8, 0
    with np.errstate(over="ignore"):
        if n >= 32:
            v = [np.full(m, s + _P1 + _P2), np.full(m, s + _P2), np.full(m, s), np.full(m, s - _P1)]
            while at + 4 <= lanes:
                for i in range(4):
                    v[i] = _step(v[i], whole[:, at + i])
                at += 4
            h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                h = (h ^ _step(np.zeros(m, np.uint64), x)) * _P1 + _P4
        else:
            h = np.full(m, s + _P5)
        h = h + tc.U(n)
        for i in range(at, lanes):
            h = _rotl(h ^ _step(np.zeros(m, np.uint64), whole[:, i]), 27) * _P1 + _P4
        at = lanes * 8
        if n - at >= 4:
            h = _rotl(h ^ (rows[:, at:at + 4].copy().view("<u4")[:, 0].astype(np.uint64) * _P1), 23) * _P2 + _P3
            at += 4
        for i in range(at, n):
            h = _rotl(h ^ (rows[:, i].astype(np.uint64) * _P5), 11) * _P1
        h = (h ^ (h >> tc.U(33))) * _P2
        h = (h ^ (h >> tc.U(29))) * _P3
        return h ^ (h >> tc.U(32))


def span_xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each byte span; spans of equal length are hashed together."""
    size = ends - starts
    out = np.empty(len(starts), np.uint64)
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for rows in np.split(order, cuts) if len(order) else []:
        n = int(size[rows[0]])
        if n > _LONG:
            out[rows] = [xxhash.xxh64_intdigest(data[a:a + n].tobytes(), seed) for a in starts[rows].tolist()]
            continue
        for i in range(0, len(rows), tc.CHUNK // 16):
            part = rows[i:i + tc.CHUNK // 16]
            out[part] = _equal_length(data[starts[part][:, None] + np.arange(n)], seed)
    return out


def shingle_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each document's shingles, repeats included, end to end, and each document's first one."""
    low = tc.LOWER[data]
    starts, ends, wo = tc.words(low, off)
    # the words again, each followed by one space: a shingle is one span of it
    size = ends - starts + 1
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.full(int(at[-1]), 0x20, np.uint8)
    inside = np.ones(len(flat), bool)
    inside[at[1:] - 1] = False
    word = np.zeros(len(low) + 1, np.int64)
    np.add.at(word, starts, 1)
    np.add.at(word, ends, -1)
    flat[inside] = low[np.cumsum(word[:-1]) > 0]
    n = np.diff(wo)
    room = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    own = np.repeat(np.arange(len(n)), room)
    first = np.concatenate([[0], np.cumsum(room)])
    head = np.arange(int(room.sum())) - first[:-1][own] + wo[:-1][own]
    last = head + np.minimum(n[own], SHINGLE)
    return span_xxh64(flat, at[head], at[last] - 1), first


def fingerprints(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each document the bits set in over half of its hashes; zero without hashes."""
    n = np.diff(first)
    votes = np.zeros((len(n), 64), np.int64)
    own = np.repeat(np.arange(len(n)), n)
    for lo in range(0, len(h), _VOTES):
        part, who = h[lo:lo + _VOTES], own[lo:lo + _VOTES]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begins = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        votes[who[begins]] += np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
    return np.packbits(2 * votes > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def simhash(docs: DataFrame) -> DataFrame:
    """(id, fp) of every row. No shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in tc.slices(batches, "__text", 1 << 20):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fingerprints(*shingle_hashes(data, off)).view(np.int64))],
                                             ["id", "fp"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.col("text").alias("__text"))
    return rows.mapInArrow(run, "id long, fp long")


def masks(level: int, radius: int = RADIUS) -> list[int]:
    """The tables' bit masks under the code of a level: position i takes part in table v if code[i] and v overlap oddly.

    The codes are dealt evenly, so every table compares about half of the bits.
    """
    codes = np.arange(64) % ((1 << radius + 1) - 1) + 1
    np.random.default_rng(1200 + level).shuffle(codes)
    return [sum(1 << i for i in range(64) if (int(codes[i]) & v).bit_count() & 1) for v in range(1, 1 << radius + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _dealt(rows: DataFrame, level: int, radius: int) -> DataFrame:
    """Each row once for every table of the level; ``bucket`` names the table, the compared bits and the bucket before."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(_signed(m)).cast("long").alias("m"))
                       for t, m in enumerate(masks(level, radius))])
    x = rows.withColumn("mask", F.explode(tables))
    seen = F.col("fp").bitwiseAND(F.col("mask.m"))
    return x.withColumn("bucket", F.xxhash64("bucket", F.lit(level), "mask.t", seen)).drop("mask")


def _near(a: Column, b: Column, radius: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def _forest(radius: int):
    """Links between different components of a group (with ``side``: of its two blocks): at most a spanning forest."""
    def run(table: pa.Table) -> pa.Table:
        fp, comp = table["fp"].to_numpy().view(np.uint64), table["comp"].to_numpy().copy()
        side = table["side"].to_numpy()
        us, vs = [], []
        right = np.flatnonzero(side != 0)
        for i in np.flatnonzero(side != 1):
            near = right[np.bitwise_count(fp[right] ^ fp[i]) <= radius]
            near = near[comp[near] != comp[i]]
            while len(near):  # one round for each component that joins
                us.append(int(fp[i].view(np.int64)))
                vs.append(int(fp[near[0]].view(np.int64)))
                comp[comp == comp[near[0]]] = comp[i]
                near = near[comp[near] != comp[i]]
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})
    return run


_LINK = "u long, v long"


def near_links(classes: DataFrame, radius: int = RADIUS, block: int = BLOCK, levels: int = LEVELS) -> DataFrame:
    """Links (u, v) between distinct fingerprints (``fp``) whose components are those of all pairs within the radius."""
    rows = materialize(_dealt(classes.select("fp", F.lit(0).cast("long").alias("bucket")), 0, radius), "simhash-buckets")
    pivots = rows.groupBy("bucket").agg(F.min("fp").alias("pivot"), F.max("fp").alias("other")).where("pivot <> other")
    rows = materialize(salted(rows, pivots.drop("other"), "bucket", "fp"), "simhash-shared")
    star = rows.where((F.col("fp") != F.col("pivot")) & _near(F.col("fp"), F.col("pivot"), radius))
    found = materialize(star.select(F.col("fp").alias("u"), F.col("pivot").alias("v")).distinct(), "simhash-links")
    # linked with the same class means one component; whole components wait until all links are known
    label = found.groupBy(F.col("u").alias("fp")).agg(F.min("v").alias("comp"))
    rows = rows.select("fp", "bucket").join(label, "fp", "left").select("fp", "bucket", F.coalesce("comp", "fp").alias("comp"))
    for level in range(1, levels + 1):
        mixed = rows.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count(F.lit(1)).alias("size"))
        rows = materialize(salted(rows, mixed.where("a <> b").select("bucket", "size"), "bucket", "fp"), "simhash-mixed")
        small = rows.where(F.col("size") <= block).withColumn("side", F.lit(-1))
        found = found.unionByName(materialize(small.groupBy("bucket").applyInArrow(_forest(radius), _LINK), "simhash-more"))
        rows = rows.where(F.col("size") > block)
        if rows.isEmpty():
            return found
        if level < levels:
            rows = _dealt(rows.select("fp", "bucket", "comp"), level, radius)
    parts = rows.withColumn("g", F.ceil(F.col("size") / block).cast("int"))
    parts = parts.withColumn("chunk", F.pmod(F.xxhash64("fp", "bucket"), F.col("g")).cast("int"))
    parts = parts.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    parts = parts.select("bucket", "fp", "comp", F.least("chunk", "x").alias("i"), F.greatest("chunk", "x").alias("j"),
                         F.when(F.col("chunk") == F.col("x"), -1).otherwise((F.col("chunk") > F.col("x")).cast("int")).alias("side"))
    return found.unionByName(materialize(parts.groupBy("bucket", "i", "j").applyInArrow(_forest(radius), _LINK), "simhash-blocks"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id: smallest id reachable by links) of every row."""
    found = materialize(simhash(docs), "simhash-fingerprints")
    classes = materialize(found.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    comps = components(near_links(classes, radius))
    named = classes.join(comps, classes["fp"] == comps["node"], "left").select("fp", "rep", "n", "comp")
    linked = named.where("comp is not null")
    least = linked.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_linked = salted(linked.select("fp", "comp"), least, "comp", "fp").select("fp", "component_id")
    # a fingerprint of one document without links needs no row: the document is its own component
    names = of_linked.unionByName(named.where("comp is null and n > 1").select("fp", F.col("rep").alias("component_id")))
    return salted(found, names, "fp", "id", "left").select("id", "fp", F.coalesce("component_id", "id").alias("component_id"))


def op12_simhash(docs: DataFrame) -> DataFrame:
    """The contract's digest: fingerprint and component of every document."""
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return near_duplicates(docs).select(back("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                                        back("component_id").alias("component_id"))
