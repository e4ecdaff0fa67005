"""Operators 11, 12 and 13 against brute force and SQL."""

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from flowlens.llm import joins, lexical, simhash, value_codes
from flowlens.llm import textcore as tc
from pyspark.sql import functions as F

LOWER = {i: i + 32 for i in range(65, 91)}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return sorted(map(tuple, con.sql(sql).fetchall()), key=repr)


# ---- 11 value codes

def slow_codes(vectors):
    """(code, error) by vector and the codebooks, with Python integers."""
    n, d = len(vectors), len(vectors[0])
    v = [[math.floor(4096 * x) for x in row] for row in vectors]
    codes, errors, books = [""] * n, [0] * n, []
    for p in range(8):
        a, b = p * d // 8, (p + 1) * d // 8
        part = [r[a:b] for r in v]
        book = [list(x) for x in part[:16]]

        def near(x):
            return min((sum((i - j) ** 2 for i, j in zip(x, e)), k) for k, e in enumerate(book))
        for _ in range(6):
            own = [near(x)[1] for x in part]
            for k in range(len(book)):
                mine = [x for x, o in zip(part, own) if o == k]
                if mine:
                    book[k] = [sum(c) // len(mine) for c in zip(*mine)]
        for i, x in enumerate(part):
            f, k = near(x)
            codes[i] += f"{k:02x}"
            errors[i] += f
        books += [c for e in book for c in e]
    return codes, errors, hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()


@pytest.mark.parametrize("n,d", [(90, 16), (5, 8), (40, 19), (1, 3)])
def test_codes_against_brute_force(spark, n, d):
    rng = np.random.default_rng(n)
    x = rng.normal(0, 0.3, (n, d)).astype(np.float32).astype(float)
    x[1:n // 3] = x[0]  # a third equal: ties, entries that stay unused
    labels = [None if i % 4 == 0 else int(i % 4) for i in range(n)]
    rows = [(i * 2, x[i].tolist(), labels[i]) for i in range(n)]
    odd = [(-9, None, 1), (-8, [math.nan] * d, 1), (-7, [None] + [0.1] * (d - 1), 1), (-6, [math.inf] * d, None)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").repartition(5)
    df = df.selectExpr("*", "1 AS x", "'q' AS code", "2 AS p", "3 AS __key")
    codes, errors, sha = slow_codes(x.tolist())
    per = collections.Counter()
    for e, lab in zip(errors, labels):
        per[lab] += e
    want = sorted([(i * 2, codes[i], errors[i], per[labels[i]], sha) for i in range(n)], key=repr)
    assert rows_of(value_codes.op11_value_codes(df)) == want
    assert sql_rows(value_codes.oracle(), embeddings=df.select("vec_id", "embedding", "label")) == want


def test_codes_cases(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert value_codes.op11_value_codes(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, [0.5] * 8, 1), (3, [0.25] * 8, None), (3, [0.25] * 8, None), (None, [-0.1] * 8, 1)]
    df = spark.createDataFrame(rows, schema)
    got = rows_of(value_codes.op11_value_codes(df))
    assert len(got) == 4 and [r[2] for r in got] == [0] * 4
    assert got == sql_rows(value_codes.oracle(), embeddings=df)
    with pytest.raises(Exception, match="components"):
        value_codes.op11_value_codes(spark.createDataFrame([(1, [0.1] * 8, 1), (2, [0.1] * 9, 1)], schema).coalesce(1)).collect()


def test_block_codes_give_the_integers_back():
    import pyarrow as pa
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, 24))
    v = value_codes.whole(pa.array(x.tolist(), pa.list_(pa.float64())))
    assert (v == np.floor(4096 * x)).all()
    found = [np.unique(v[:, d], return_inverse=True) for d in range(24)]
    row = {"vec_id": list(range(300)), "size": [len(u) for u, _ in found], "dictionary": np.concatenate([u for u, _ in found]),
           "codes": np.array([c for _, c in found], np.uint16).tobytes()}
    books = rng.integers(-4000, 4000, (16, 24))
    entry, error, _, _ = value_codes._assigned(row, books)
    for p in range(8):
        far = ((v[:, None, p * 3:p * 3 + 3] - books[None, :, p * 3:p * 3 + 3]) ** 2).sum(2)
        assert (entry[:, p] == far.argmin(1)).all() and (error[:, p] == far.min(1)).all()


# ---- 12 SimHash

def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(ids, prints, radius=3):
    low = list(range(len(ids)))
    while True:
        before = list(low)
        for i in range(len(ids)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= radius:
                    low[i] = low[j] = min(low[i], low[j], key=lambda k: ids[k])
        if low == before:
            return [ids[k] for k in low]


def test_span_hash_is_xxh64():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 4000).astype(np.uint8)
    starts = np.arange(300) * 12
    ends = starts + np.arange(300) % 150
    want = [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(starts, ends)]
    assert simhash.span_xxh64(data, starts, ends).tolist() == want


def test_simhash_against_brute_force(messy, no_docs):
    big = simhash.NULL_ID
    docs = [(big if r.doc_id is None else r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()]
    prints = [slow_fingerprint(t) for _, t in docs]
    comps = slow_components([d for d, _ in docs], prints)
    want = sorted([(None if d == big else d, f"{f:016x}", None if c == big else c) for (d, _), f, c in zip(docs, prints, comps)], key=repr)
    got = simhash.op12_simhash(messy)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert rows_of(got) == want
    assert simhash.op12_simhash(no_docs).collect() == []


def test_every_pair_within_the_radius_shares_a_table():
    rnd = random.Random(2)
    for radius in (1, 3, 4):
        for level in range(simhash.LEVELS):
            ms = simhash.masks(level, radius)
            assert len(ms) == 2 ** (radius + 1) - 1
            for _ in range(1500):
                diff = sum(1 << i for i in rnd.sample(range(64), radius))
                assert any(m & diff == 0 for m in ms)


@pytest.mark.parametrize("block,levels", [(4096, 3), (8, 3), (8, 1)])
def test_links_find_every_component(spark, block, levels):
    """Chains, dense groups and unrelated fingerprints: components as by all pairs, whatever the bucket sizes allowed."""
    rnd = random.Random(5)
    prints = {rnd.getrandbits(64) for _ in range(150)}
    centre = rnd.getrandbits(64)
    for _ in range(250):  # a dense group in which most pairs are further apart than the radius
        prints.add(centre ^ sum(1 << i for i in rnd.sample(range(64), rnd.randint(1, 4))))
    x = rnd.getrandbits(64)
    for i in range(0, 60, 3):  # a chain: each step differs in three bits
        x ^= 7 << i
        prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    from flowlens.llm.graph import components
    links = simhash.near_links(df, block=block, levels=levels)
    comp = {r.node: r.comp for r in components(links).collect()}
    got = [comp.get(s, s) for s in signed]
    want = slow_components(signed, prints)
    group = lambda c: sorted(map(sorted, {k: [s for s, l in zip(signed, c) if l == k] for k in set(c)}.values()))
    assert group(got) == group(want)
    assert all((a ^ b).bit_count() <= 3 for a, b in ((r.u % (1 << 64), r.v % (1 << 64)) for r in links.collect()))


def test_hot_bucket_returns_a_forest(spark):
    import pyarrow as pa
    rng = np.random.default_rng(0)
    fp = np.unique(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3000, 2)).astype(np.uint64), axis=1))
    t = pa.table({"fp": fp.view(np.int64), "comp": fp.view(np.int64), "side": np.full(len(fp), -1)})
    assert simhash._forest(3)(t).num_rows <= len(fp) - 1


def test_salted_join_keeps_every_row(spark):
    large = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 7, if(id % 3 = 1, null, id)) AS k")
    small = spark.createDataFrame([(7, "hot"), (None, "none"), (8, "eight")], "k long, v string")
    got = {r.id: r.v for r in joins.salted(large, small, "k", "id", "left").collect()}
    assert len(got) == 1000 and got[8] == "eight" and got[11] is None
    assert all(got[i] == ("hot" if i % 3 == 0 else "none") for i in range(1000) if i % 3 < 2)
    assert joins.salted(large, small, "k", "id").groupBy(F.spark_partition_id()).count().count() > 1


# ---- 13 lexical search

def slow_search(docs, items, k=10):
    split = lambda t: re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    bags = [(d, collections.Counter(split(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, words = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    held = collections.defaultdict(set)
    for i, t in items:
        held[i].update(split(t))
    out = []
    for i, ts in held.items():
        hits = []
        for d, b in bags:
            m = 10 + 90 * sum(b.values()) * n_docs // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * b[t] // (1000 * b[t] + 8 * m))
                    for t in ts if t in b)
            if s > 0:
                hits.append((-s, math.inf if d is None else d, d))
        out += [(i, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(hits)[:k])]
    return sorted(out, key=repr)


ITEMS = [(0, "Wort1 wort2, wort3!"), (1, "WORT7-wort7 x"), (2, None), (3, "..."), (None, "né ünd ab"), (5, "a|b wort9"),
         (5, "wort10"), (6, "zzz nowhere"), (7, "wort1 " * 50 + "und"), (8, "Ünd Né wort11  wort12")]


def test_search_against_brute_force(spark, messy, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS rank")
    docs = [tuple(r) for r in messy.select("doc_id", "text").collect()]
    want = slow_search(docs, ITEMS)
    got = lexical.op13_lexical(messy, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(got) == want
    assert sql_rows(lexical.oracle(), documents=messy.select("doc_id", "text"), benchmark=items.select("item_id", "text")) == want
    several = lexical.search(messy, items, shard_bytes=60)  # several automata
    assert rows_of(several.select("item_id", "rank", F.when(F.col("id") != lexical.NULL_ID, F.col("id")), "score")) == want
    assert lexical.op13_lexical(no_docs, items).collect() == []
    assert lexical.op13_lexical(messy, items.limit(0)).collect() == []


def test_search_ties_go_to_the_smaller_document(spark, monkeypatch):
    rows = [(i, "same words here") for i in range(400, 0, -1)] + [(1000 + i, "other text") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    items = spark.createDataFrame([(1, "same WORDS"), (2, "text")], "item_id long, text string")
    monkeypatch.setattr(lexical, "_CELLS", 14)  # a few documents at once
    got = rows_of(lexical.op13_lexical(docs, items))
    assert got == slow_search(rows, [(1, "same words"), (2, "text")])
    assert [r[2] for r in sorted(got) if r[0] == 1] == list(range(1, 11))


def test_matches_stay_in_their_document():
    import pyarrow as pa
    items = lexical.Items([1], [{b"ab", b"b", b"c"}])
    texts = ["ab", "ab b", "b", "", None, "abc ab-ab", "c" * 3, "éab ab"]
    data, off = tc.text_bytes(pa.array(texts))
    n, own, term, tf = lexical.counts(items.automaton(), 3, data, off)
    assert n.tolist() == [1, 2, 1, 0, 0, 3, 1, 2]
    assert list(zip(own.tolist(), [items.terms[t] for t in term], tf.tolist())) == [
        (0, b"ab", 1), (1, b"ab", 1), (1, b"b", 1), (2, b"b", 1), (5, b"ab", 2), (7, b"ab", 1)]
