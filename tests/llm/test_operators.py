"""Operators 1, 3, 4, 5, 6, 8, 9 and 10 and the pipeline against brute force, exact round trips and held-out labels."""

import collections
import importlib
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from flowlens.llm import (
    byte_cnn, graph, mixing, near_dup, neighbours, packing, quality_rules, queries, token_ids, toxicity, warc_revisit,
)
from flowlens.llm import textcore as tc

PATH = public_tokenizers.path("word_bpe_49k.json")
BIG = 1 << 62
SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def values(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def oracle_rows(sql, docs, name="documents"):
    con = duckdb.connect()
    con.register(name, docs.toPandas())
    con.execute(f"CREATE TABLE t AS SELECT * FROM {name}")
    con.unregister(name)
    con.execute(f"ALTER TABLE t RENAME TO {name}")
    return con.sql(sql)


# ---- 8 quality rules

def slow_measures(t):
    t = t or ""
    ws = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    at = collections.defaultdict(list)
    for i in range(len(ws) - 7):
        at[tuple(ws[i:i + 8])].append(i)
    covered = {p for hits in at.values() if len(hits) > 1 for i in hits for p in range(i, i + 8)}
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_rules_against_brute_force(messy):
    got = values(quality_rules.op8_quality_rules(messy), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                 "n_repeat_words", "base_failed")
    want = []
    for r in messy.select("doc_id", "text").collect():
        m = slow_measures(r.text)
        want.append((r.doc_id, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    assert got == sorted(want, key=repr)


def test_rules_keep_and_ablation(messy, no_docs):
    kept = quality_rules.keep(messy)
    assert kept.columns == messy.columns
    verdicts = collections.Counter(r.doc_id for r in quality_rules.op8_quality_rules(messy).where("kept").collect())
    assert collections.Counter(r.doc_id for r in kept.collect()) == verdicts
    entries = quality_rules.ledger(messy)
    bits = [r.failed_bits for r in entries.collect()]
    for r in quality_rules.ablations(entries).collect():
        m, bit = quality_rules.mask(r.policy), 1 << [n for n, _ in quality_rules.RULES].index(r.rule)
        assert (r.rejected, r.only_by_this_rule) == (sum(b & m != 0 for b in bits), sum(b & m == bit for b in bits))
    assert quality_rules.op8_quality_rules(no_docs).count() == 0 and quality_rules.keep(no_docs).count() == 0


# ---- 6 near duplicates

def slow_components(rows, groups=False):
    """rows: [(id, text)] -> [(id, size, component)]; null ids as BIG. groups: the number of components with words instead."""
    sets = []
    for _, t in rows:
        ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)]
        sets.append({tuple(ws[i:i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set())
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), BIG), d)
    if groups:
        return len({root(i) for i in range(len(rows)) if sets[i]})
    return [(d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)]


def near_rows(df):
    return sorted((BIG if r.doc_id is None else r.doc_id, r.n_shingles, BIG if r.component_id is None else r.component_id)
                  for r in near_dup.op6_near_dup(df).collect())


def test_near_dup_against_brute_force(messy, no_docs):
    rows = [(BIG if r.doc_id is None else r.doc_id, r.text) for r in messy.collect()]
    assert near_rows(messy) == sorted(slow_components(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in near_dup.op6_near_dup(messy).where("doc_id is not null").collect())
    assert near_dup.op6_near_dup(no_docs).count() == 0


def test_chains_of_copies(spark, monkeypatch):
    """Copies of copies: neighbours in a chain are links, its ends are far apart; many share a bucket."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rnd = random.Random(3)
    rows, text = [], [f"w{i}" for i in range(150)]
    for i in range(60):
        rows.append((i * 7 % 60, " ".join(text)))
        text[rnd.randrange(150)] = f"x{i}"
        if i % 20 == 19:
            text = [f"v{i}-{k}" for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_rows(df) == sorted(slow_components(rows))


def test_classes_whose_first_hash_agrees(spark, messy, monkeypatch):
    """With the first hash of a set cut to two bits, different sets still are different classes."""
    names = near_dup._names
    monkeypatch.setattr(near_dup, "_names", lambda h, so: (names(h, so)[0] & 3, names(h, so)[1]))
    rows = [(BIG if r.doc_id is None else r.doc_id, r.text) for r in messy.collect()]
    assert near_rows(messy) == sorted(slow_components(rows))


def test_a_stray_copies_a_bucket_once(spark, monkeypatch):
    """One class of another component in a bucket: each class of the large component goes to one block pair."""
    monkeypatch.setattr(near_dup, "BLOCK", 10)
    rows = [(7, i, 1 if i else 0) for i in range(1000)] + [(8, i, 1) for i in range(1, 50)] + [(9, i, i % 2) for i in range(24)]
    got = near_dup.block_rows(spark.createDataFrame(rows, "bucket long, node long, comp long")).collect()
    one = [r for r in got if r.bucket == 7]
    assert len(one) == 999 + 1 + 100  # the stray meets itself and 100 blocks
    assert not [r for r in got if r.bucket == 8]
    pairs = collections.defaultdict(list)
    for r in got:
        pairs[r.bucket, r.i, r.j].append(r)
    met = {frozenset((x.node, y.node)) for (b, i, j), rs in pairs.items() if b == 9
           for x in rs for y in rs if x.chunk == i and y.chunk == j and x.node != y.node}
    assert {frozenset((a, b)) for a in range(0, 24, 2) for b in range(1, 24, 2)} <= met


def test_near_dup_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert near_rows(docs) == sorted(slow_components([(r.doc_id, r.text) for r in docs.collect()]))


def test_keep_one_leaves_one_of_each_group(messy):
    kept = near_dup.keep_one(messy)
    assert kept.columns == messy.columns
    got = collections.Counter(r.doc_id for r in kept.collect())
    filled = [r for r in kept.collect() if words(r.text)]
    assert len(filled) == slow_components([(BIG if r.doc_id is None else r.doc_id, r.text) for r in messy.collect()], groups=True)
    assert got[25] == 0 and got[1] == 1 and got[2] == 1


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(50)]
    comp = {}

    def root(i):
        while comp.setdefault(i, i) != i:
            i = comp[i]
        return i

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        comp[b] = a
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: root(n) for e in edges if e[0] != e[1] for n in e}


# ---- 4 mixing

def test_mixing_against_sql(messy, no_docs):
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    got = [(d, s, ss, round(t, 6), k) for d, s, ss, t, k in values(mixing.op4_mixing(messy), *cols)]
    docs = messy.select("doc_id", "text", "source")
    want = oracle_rows(mixing.oracle(), docs).select(*cols).fetchall()
    totals = lambda rows: {k: sum(r[4] for r in rows if r[2] == k) for k in {r[2] for r in rows}}
    assert sorted(r[:4] for r in got if r[0]) == sorted((int(d), s, ss, round(t, 6)) for d, s, ss, t, _ in want if d and d == d)
    assert totals(got) == totals(want)
    assert all(r[4] <= 3 * r[1] for r in got) and mixing.op4_mixing(no_docs).count() == 0


def test_schedule_interleaves_sources(messy):
    _, sources, mix = mixing.mixture(messy, block=16)
    share = {r.s: r.quota for r in sources.collect()}
    slots = sorted({(r.slot, r.s) for r in mix.select("slot", "s").collect()})
    half = slots[:len(slots) // 2]
    for s, q in share.items():
        assert abs(sum(x == s for _, x in half) - len(half) * q / sum(share.values())) <= 4
    per = collections.Counter()
    for r in mix.collect():
        per[r.s] += r.words
        assert 0 <= r.place and r.place + r.words <= 16
    assert per == {s: q for s, q in share.items() if q}


def test_mix_repeats_and_cuts_texts(messy):
    out = mixing.mix(messy)
    assert out.columns == messy.columns
    got = collections.Counter()
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    want = collections.Counter()
    for r in mixing.op4_mixing(messy).collect():
        want[r.doc_id] += r.taken
    assert got == +want


def test_mix_of_one_text_in_two_sources(spark):
    text = " ".join(f"w{i}" for i in range(13))
    rows = [(1, text, "a"), (1, text, "b"), (2, "x y z " * 4, "a"), (3, "p q", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {r.source: r.target for r in mixing.mixture(docs)[1].select("source", "target").collect()}
    got = collections.Counter()
    for r in mixing.mix(docs).collect():
        got[r.source] += len(words(r.text))
    assert {s: round(t) for s, t in want.items()} == got


def test_mixing_twice_agrees(messy):
    cols = ["doc_id", "size", "taken"]
    assert values(mixing.op4_mixing(messy.repartition(7)), *cols) == values(mixing.op4_mixing(messy.repartition(3)), *cols)


# ---- 3 packing

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_librarys(tokenizer):
    rnd = random.Random(3)
    letters = "aZ09'!?<|>_ \n\t\x00\x1f\x7féİΣ́Å 　x"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    texts += ["a<|endoftext|>b", " <|startoftext|> q", "<|ENDOFTEXT|>", "it's we'll '", "", "x" * 5000]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    ids, io = token_ids.Encoder(PATH).encode(np.frombuffer(b"".join(raw), np.uint8), off, 2)
    for i, t in enumerate(texts):
        assert ids[io[i]:io[i + 1]].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2]


def test_packing_round_trip(messy, no_docs, tokenizer):
    rows = packing.pack(messy, PATH).collect()
    per = collections.defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        per[r.sequence_id].append((r.offset, r.length))
    for parts in per.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    whole = collections.Counter()
    seen = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r.start):
        seen[r.doc_id, r.doc_tokens, r.start].append(r.ids)
    for (d, n, s), x in seen.items():
        whole[d] += sum(len(i) // 4 for i in x)
    want = collections.Counter()
    for r in messy.collect():
        want[r.doc_id] += len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
    assert whole == want
    empty = [r for r in rows if r.doc_id == 1]
    assert [struct.unpack("<I", r.ids) for r in empty] == [(2,)]
    assert packing.pack(no_docs, PATH).count() == 0


def test_differencing_is_near_equal():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 513, 900).tolist()
    windows = packing.pack_group(sizes)
    loads = [sum(sizes[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(900))
    assert max(loads) <= 4096 and len(windows) <= -(-sum(sizes) // 4096) + 2 and max(loads) - min(loads) < 200
    assert packing.differencing([5], 3).count([]) == 2 and packing.pack_group([]) == []
    assert packing.pack_group([4000, 4000, 4000, 200, 200]) and len(packing.pack_group([4000] * 3)) == 3


# ---- 5 WARC revisits

def test_revisits(spark, no_docs):
    rows = [(1, "http://www.A.com/x/?b=2&a=1&utm_source=q#f", 10, "response", {"ETag": '"v1"', "X": "1", "Vary": "a"}, "one"),
            (2, "https://a.com:443/x?a=1&b=2", 20, "response", {"ETag": 'W/"v2"'}, "two"),
            (3, "https://a.com/x?a=1&b=2", 15, "revisit", {"etag": 'W/"v1"', "Vary": "b", "X": "9"}, None),
            (4, "https://a.com/x?a=1&b=2", 25, "revisit", {"ETag": '"v1"'}, None),
            (5, "https://a.com/x?a=1&b=2", 10, "revisit", {"ETag": '"v1"'}, None),
            (6, "https://a.com/x?a=1&b=2", 20, "revisit", None, None), (7, None, 5, "revisit", {}, None),
            (8, "https://a.com/x?a=1&b=2", None, "revisit", None, None), (9, "http://b.org", 1, "response", None, None),
            (10, "http://b.org/", 2, "revisit", {"Last-Modified": "m"}, None), (11, "http://b.org/", 2, "metadata", None, None),
            (4, "https://a.com/x?a=1&b=2", 25, "revisit", {"ETag": '"v1"'}, None)]
    df = spark.createDataFrame(rows, "record_id long, url string, time long, kind string, headers map<string,string>, payload string")
    got = {r.record_id: r for r in warc_revisit.resolve(df).collect()}
    assert {k: (r.resolution, r.target_id, r.payload) for k, r in got.items()} == {
        3: ("resolved", 1, "one"), 4: ("mismatch", 2, None), 5: ("missing", None, None), 6: ("unverified", 1, None),
        7: ("missing", None, None), 8: ("missing", None, None), 10: ("unverified", 9, None)}
    assert got[3].headers == {"etag": 'W/"v1"', "x": "1", "vary": "b"}
    assert warc_revisit.resolve(df).count() == 8 and warc_revisit.resolve(df.limit(0)).count() == 0


def test_hot_url_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(warc_revisit, "BUCKET_ROWS", 50)
    rnd = random.Random(1)
    rows = [(i, "http://a.com/", rnd.randrange(300), rnd.choice(["response", "revisit"]), {"ETag": "x"}, str(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "record_id long, url string, time long, kind string, headers map<string,string>, payload string")
    full = [(t, i) for i, _, t, k, *_ in rows if k == "response"]
    want = {i: max(((a, b) for a, b in full if a < t), default=(0, None))[1] for i, _, t, k, *_ in rows if k == "revisit"}
    assert {r.record_id: r.target_id for r in warc_revisit.resolve(df).collect()} == want


def test_urls_without_scheme_stand_for_themselves(spark):
    rows = [(1, "www.a.org/x", 1, "response", {"ETag": "t"}, "a"), (2, "dns:b.org", 2, "response", {"ETag": "t"}, "b"),
            (3, "dns:b.org#q", 5, "revisit", {"ETag": "t"}, None), (4, "www.a.org/x", 5, "revisit", {"ETag": "t"}, None),
            (5, "dns:c.org", 5, "revisit", {"ETag": "t"}, None), (6, "", 1, "response", {"ETag": "t"}, "c"),
            (7, "", 5, "revisit", {"ETag": "t"}, None), (8, "#f", 5, "revisit", {"ETag": "t"}, None),
            (9, "http://", 5, "revisit", {"ETag": "t"}, None), (10, "http://www.a.org/x", 5, "revisit", {"ETag": "t"}, None)]
    df = spark.createDataFrame(rows, "record_id long, url string, time long, kind string, headers map<string,string>, payload string")
    got = {r.record_id: (r.resolution, r.payload, r.canonical_url) for r in warc_revisit.resolve(df).collect()}
    none = ("missing", None, None)
    assert got == {3: ("resolved", "b", "opaque:dns:b.org"), 4: ("resolved", "a", "opaque:www.a.org/x"), 7: none, 8: none, 9: none,
                   5: ("missing", None, "opaque:dns:c.org"), 10: ("missing", None, "a.org/x")}


def test_revisits_of_odd_pages_against_sql(spark):
    urls = ["http://a.org/1", "dns:b.org", "", None, "https://www.a.org/1/?utm_x=1", "http://c.org/?b=1&a=2", "http://", "a.org/1"]
    rows = [(i, urls[i * 5 % 8], [None, "", "<p>x</p>"][i % 3]) for i in range(240)] + [(300, urls[0], "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc_revisit.op5_warc_revisit(pages.selectExpr("*", "1 AS time", "'c' AS c", "2 AS bucket", "3 AS record_id"))
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    want = con.sql(warc_revisit.oracle())
    assert values(got, *want.columns) == sorted(want.fetchall(), key=repr)
    seen = {r.resolution for r in got.collect()}
    assert seen == {"resolved", "mismatch", "unverified", "missing"}
    assert warc_revisit.op5_warc_revisit(pages.limit(0)).collect() == []


# ---- 1 and 9 classifiers

def test_sample_bounds_the_joined_rows(spark):
    from flowlens.llm import labelled
    from pyspark.sql import functions as F
    docs = spark.range(5000).selectExpr("id % 8 AS doc_id", "concat('t', id) AS text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(0, 0)], "doc_id long, quality int")
    got = labelled.sample(docs, labels, "quality", F.lit(False), 2)
    assert got.count() == 2 and got.exceptAll(labelled.sample(docs.repartition(5), labels, "quality", F.lit(False), 2)).isEmpty()


def test_training_parts_share_out_the_whole_text():
    text = bytes(range(256)) * 2000
    cut = byte_cnn.parts(text)
    assert len(cut) == byte_cnn.EPOCHS and all(len(c) == byte_cnn.TRAIN_BLOCKS * byte_cnn.BLOCK for c in cut)
    rng = np.random.default_rng(0)
    odd = rng.integers(0, 256, 500_000).astype(np.uint8).tobytes()
    at = [odd.index(c[:64]) for c in byte_cnn.parts(odd)]
    share = (len(odd) - byte_cnn.TRAIN_BLOCKS * byte_cnn.BLOCK) / byte_cnn.EPOCHS
    assert all(e * share - byte_cnn.BLOCK <= a <= (e + 1) * share + byte_cnn.BLOCK for e, a in enumerate(at))
    assert byte_cnn.parts(b"") == [b""] and byte_cnn.parts(b"x" * 6144) == [b"x" * 6144]


@pytest.mark.parametrize("op,target,fold", [(byte_cnn.op1_quality, "quality", (4, 2)), (toxicity.op9_toxicity, "toxic", (3, 1))])
def test_held_out_labels(spark, op, target, fold):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    x = op(docs, labels)
    got = x.join(labels, "doc_id").toPandas()
    crc = got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % fold[0] == fold[1])
    assert (crc == got.held_out).all() and got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    held = got[got.held_out]
    right = held.predicted == held[target]
    assert right.mean() > 0.95
    assert right[held[target] == 1].mean() > 0.8 and right[held[target] == 0].mean() > 0.9


@pytest.mark.parametrize("op", [byte_cnn.op1_quality, toxicity.op9_toxicity])
def test_classifier_cases(spark, messy, no_docs, op):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in op(messy, none).collect()} == {0.5}
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)] + [(None, 1, 1), (3, None, None)], none.schema)
    rows = op(messy, labels).collect()
    assert len(rows) == messy.count() and all(0 <= r.score <= 1 for r in rows) and not any(r.held_out for r in rows if r.doc_id is None)
    assert op(no_docs, labels).count() == 0


def test_cnn_covers_the_whole_document(monkeypatch):
    rng = np.random.default_rng(0)
    m = byte_cnn.initial(4)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    off = np.array([0, 0, 1, 130, 4000, 5000])
    codes, first = byte_cnn.layout(data, off)
    want = byte_cnn._forward(codes, first, m)[0]
    assert np.allclose(byte_cnn.scores(data, off, m), want, atol=1e-5)
    a = byte_cnn._forward(codes, first, m)[1][3]
    assert len(a) == (np.maximum(1, -(-np.diff(off) // byte_cnn.BLOCK))).sum()


def test_cnn_gradient():
    rng = np.random.default_rng(1)
    m = {k: v.astype(np.float64).astype(np.float32) for k, v in byte_cnn.initial(2).items()}
    data, off = rng.integers(97, 105, 700).astype(np.uint8), np.array([0, 300, 700])
    codes, first = byte_cnn.layout(data, off)
    y, w = np.array([1, 0], np.float32), np.ones(2, np.float32)

    def loss():
        p = byte_cnn._forward(codes, first, m)[0]
        return float(-(np.log(p[0]) + np.log(1 - p[1])) / 2)

    g = byte_cnn._gradient(codes, first, y, w, m)
    for name, at in (("K", (5, 3)), ("H", (2, 2)), ("u", (1,)), ("b", (4,)), ("E", (100, 2))):
        keep = m[name][at]
        m[name][at] = keep + 1e-2
        up = loss()
        m[name][at] = keep - 1e-2
        down = loss()
        m[name][at] = keep
        assert abs((up - down) / 2e-2 - g[name][at]) < 0.02 + 0.2 * abs(g[name][at])


def test_machine_learns_an_interaction():
    """An insult is toxic only beside a group mention: the pair's product decides, not the weights of either."""
    rng = np.random.default_rng(0)
    docs, labels = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.4
        docs.append(np.unique(np.concatenate([rng.integers(100, 160, 6), [7] * int(a), [9] * int(b)]).astype(np.int64)))
        labels.append(int(a and b))
    m = toxicity.fit(docs, labels)
    at = {i: int(np.flatnonzero(m["ids"] == i)[0]) for i in (7, 9)}
    z = {d: toxicity._logit(np.array([at[i] for i in d]), np.array([0, len(d)]), m["w"], m["v"], m["b"])[0][0] for d in ((7,), (9,), (7, 9))}
    assert z[7, 9] > 1 and z[7,] < -1 and z[9,] < -1
    assert m["v"][at[7]] @ m["v"][at[9]] > max(m["w"][at[7]], m["w"][at[9]])


# ---- 10 neighbours

def test_neighbours_recall_and_cases(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    extra = spark.createDataFrame([(10_000, [float("nan")] * 64), (10_020, None), (10_040, [0.0] * 64), (10_060, [1.0]), (None, [1.0] * 64),
                                   (10_080, [None] + [1.0] * 63)], "vec_id long, embedding array<float>")
    twins = table.where("vec_id = 40").selectExpr("explode(sequence(20000, 20039)) vec_id", "embedding")
    rows = table.select("vec_id", "embedding").unionByName(extra).unionByName(twins).unionByName(table.where("vec_id = 60").select("vec_id", "embedding"))
    got = neighbours.op10_neighbours(rows.selectExpr("*", "1 AS node", "2 AS x", "3 AS u")).toPandas()
    good = {r.vec_id: r.embedding for r in table.unionByName(twins, allowMissingColumns=True).collect()}
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids], np.float64)
    asked = ids[ids % 20 == 0]
    assert sorted(set(got.query_id)) == asked.tolist()
    hit = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[np.searchsorted(ids, q)]
        s[ids == q] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(g.vec_id))
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and q not in set(g.vec_id)
        assert np.allclose(g.score, s[np.searchsorted(ids, g.vec_id)], atol=1e-12) and (np.diff(g.score) <= 0).all()
    assert hit / 20 / len(asked) > 0.95
    assert got[got.query_id == 40].sort_values("rank").vec_id.tolist() == list(range(20000, 20020))


def test_recall_holds_as_the_table_grows(spark):
    """Uniform directions, a hard case: the recall at two sizes, each against brute force."""
    rng = np.random.default_rng(4)
    for n in (1500, 12000):
        x = rng.standard_normal((n, 32)).astype(np.float32).astype(np.float64)
        table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
        hit = 0
        got = neighbours.nearest(table, every=100).toPandas()
        for q, g in got.groupby("query_id"):
            s = x @ x[q]
            s[q] = -np.inf
            hit += len(set(np.argsort(-s)[:20].tolist()) & set(g.vec_id))
        assert hit / 20 / -(-n // 100) >= 0.9
    assert neighbours.width(10**9) > 2 * neighbours.width(10**6) > 4 * neighbours.width(1000)


def test_few_neighbours(spark):
    rows = [(20, [1.0, 0.0]), (21, [0.5, 0.5]), (22, [-1.0, 0.0])]
    got = values(neighbours.op10_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), "query_id", "rank", "vec_id", "score")
    assert got == [(20, 1, 21, 0.5), (20, 2, 22, -1.0)]
    assert neighbours.op10_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ---- pipeline and registration

def test_pipeline_stages(spark):
    pipe = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    x, sizes = docs, [docs.count()]
    for _, stage in pipe.STAGES[:-1]:
        y = stage(spark, x, SF)
        rows = y.collect()
        assert y.columns == docs.columns
        x = spark.createDataFrame(rows, docs.schema)
        sizes.append(len(rows))
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] <= sizes[2]
    out = pipe.run(spark, SF)
    assert out.agg({"length": "sum"}).first()[0] > 0


def test_near_stage_takes_pairs_from_80_percent(spark):
    """Planted pairs with 5-word shingle sets of similarity 0.79 to 0.86: the stage links from 0.80 on, op6 from 0.85 on."""
    pipe = importlib.import_module("corpus_pipeline")
    rows, share = [], {}
    for i in range(120):
        n = 200 + i
        a = [f"d{i}w{k}" for k in range(n)]
        cut = 10 + (i * 7) % 30  # words changed at the end: cut shingles of n - 4 differ on either side
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(a[:n - cut] + [f"x{i}w{k}" for k in range(cut)]))]
        share[2 * i + 1] = (n - 4 - cut, n - 4 + cut)
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    gone = lambda percent: {d for d, (both, all_) in share.items() if 100 * both >= percent * all_}
    assert len(gone(80) - gone(85)) > 20 and len(share) > len(gone(80))
    everyone = {d for d, _ in rows}
    assert everyone - {r.doc_id for r in pipe.near_duplicates(spark, docs, SF).collect()} == gone(80)
    assert {r.doc_id for r in near_dup.op6_near_dup(docs).where("not kept").collect()} == gone(85)


def test_pipeline_stages_on_odd_tables(spark, messy, no_docs):
    import corpus_pipeline as cp
    for docs in (messy, no_docs, messy.where("text is null or trim(text) = ''")):
        alone = docs.count()
        for name, stage in cp.STAGES:  # each by itself on odd input
            out = stage(spark, docs, SF)
            n = out.count()
            if name != "packing":
                assert out.columns == list(cp.COLUMNS)
                assert out.where("text is null or not text rlike '[^\\\\x20\\\\x09-\\\\x0D]'").count() == 0 or name in ("near_duplicates", "substring_dedup")
            assert (n == 0) == (alone == 0) or docs is not messy
        kept = docs
        for name, stage in cp.STAGES:  # and one after another
            kept = stage(spark, kept, SF)
        assert (kept.count() == 0) == (docs is not messy)


def test_long_text_of_megabytes(spark):
    """One text of 3 MB through the scans: the same results as by brute force."""
    rnd = random.Random(11)
    long = " ".join("w%d" % rnd.randrange(50000) for _ in range(450_000))
    docs = spark.createDataFrame([(1, long, "en", "a", len(long)), (2, long[:1000], "en", "a", 1000), (3, "x", "en", "b", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in quality_rules.op8_quality_rules(docs).collect()}
    assert (got[1].n_words, got[1].word_chars) == (450_000, len(long) - 449_999)
    near = {r.doc_id: r for r in near_dup.op6_near_dup(docs).collect()}
    assert near[1].n_shingles == len({tuple(w) for w in zip(*(long.split(" ")[i:] for i in range(5)))})
    from flowlens.llm import simhash, substring_dedup
    assert {r.doc_id for r in simhash.op12_simhash(docs).collect()} == {1, 2, 3}
    sub = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.op7_substring_dedup(docs).collect()}
    last = long[:1000].count(" ") + 1
    whole = last if long[1000] == " " else last - 1
    assert sub[1] == (450_000, 0) and sub[2] == (last, whole)


def test_every_query_is_registered():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(queries.ORACLE) <= names and set(entry.oracle_sql()) <= names


def test_slices_hold_every_document(monkeypatch):
    import pyarrow as pa
    texts = ["a" * n for n in (0, 5, 0, 100, 3, 3)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got = [bytes(d[o[i]:o[i + 1]]).decode() for rows, d, o in tc.slices([batch], limit=6) for i in range(rows.num_rows)]
    assert got == [t or "" for t in texts]
