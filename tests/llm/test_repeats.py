"""Operators 2 and 7 against brute force over all windows."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from flowlens.llm import doubling, repeats, substring_dedup, suffix_dedup
from flowlens.llm import textcore as tc

BIG = 1 << 62


def covered(docs, length):
    """docs: [(id, sequence)]; which units a window of a document with a smaller id covers."""
    least = defaultdict(lambda: BIG)
    for d, x in docs:
        for i in range(len(x) - length + 1):
            w = tuple(x[i:i + length])
            least[w] = min(least[w], d)
    out = []
    for d, x in docs:
        gone = [False] * len(x)
        for i in range(len(x) - length + 1):
            if least[tuple(x[i:i + length])] < d:
                gone[i:i + length] = [True] * length
        out.append(gone)
    return out


def rows_of(df):
    return [(BIG if r.doc_id is None else r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def test_bytes_against_brute_force(messy):
    docs = [(d, t.encode()) for d, t in rows_of(messy)]
    want = []
    for (d, b), gone in zip(docs, covered(docs, 50)):
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    got = [(BIG if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in suffix_dedup.op2_suffix_dedup(messy).collect()]
    assert sorted(got) == sorted(want)
    assert sum(x[2] for x in got) > 0


def test_words_against_brute_force(messy):
    docs = [(d, words(t)) for d, t in rows_of(messy)]
    want = []
    for (d, ws), gone in zip(docs, covered(docs, 50)):
        kept = " ".join(w for w, g in zip(ws, gone) if not g)
        want.append((d, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [(BIG if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256)
           for r in substring_dedup.op7_substring_dedup(messy).collect()]
    assert sorted(got) == sorted(want)
    left = {r.doc_id: words(r.text) for r in substring_dedup.strip(messy).where("doc_id > 5").collect()}
    kept = {d: [w for w, g in zip(ws, gone) if not g] for (d, ws), gone in zip(docs, covered(docs, 50)) if 5 < d < BIG}
    assert left == {d: k for d, k in kept.items() if k}


def test_sample_of_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 6000")
    raw = [(d, t.encode()) for d, t in rows_of(docs)]
    want = {(d, sum(g)) for (d, _), g in zip(raw, covered(raw, 50))}
    assert {(r.doc_id, r.n_removed) for r in suffix_dedup.op2_suffix_dedup(docs).collect()} == want
    ws = [(d, words(t.decode())) for d, t in raw]
    want = {(d, sum(g)) for (d, _), g in zip(ws, covered(ws, 50))}
    assert {(r.doc_id, r.n_removed) for r in substring_dedup.op7_substring_dedup(docs).collect()} == want


def test_empty_table(no_docs):
    assert suffix_dedup.op2_suffix_dedup(no_docs).count() == 0
    assert substring_dedup.op7_substring_dedup(no_docs).count() == 0
    assert substring_dedup.strip(no_docs).columns == no_docs.columns


def test_runs_hold_every_window(monkeypatch):
    monkeypatch.setattr(tc, "CHUNK", 64)
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 1000).astype(np.uint8)
    off = np.array([0, 30, 80, 80, 500, 1000])
    lo, n, *_ = repeats.sync_runs(data, off, 50, 20, tc._BYTE)
    seen = np.concatenate([np.arange(a, a + b + 1) for a, b in zip(lo, n)])
    assert sorted(seen) == sorted(tc.doc_starts(off, 50)[0])


@pytest.mark.parametrize("parts", [1, 5, 1000])
def test_packing_round_trip(parts):
    ids, keys = np.array([4, 4, 9, 1], np.int64), np.array([1, 1, 2, 3], np.int64)
    rows = repeats._split(2, np.array([0, 0, 0, 0]), parts, ids, keys, np.array([5, 6, 7, 8], np.uint64))
    got = repeats.unpack(rows[0][2], np.uint64)
    assert [x.tolist() for x in got] == [[4, 4, 9, 1], [1, 1, 2, 3], [5, 6, 7, 8]]


def test_line_of_every_document_is_dealt(spark, monkeypatch, tmp_path):
    """A 30-byte line in all documents, in other surroundings each time: no task holds its runs, results stay exact."""
    monkeypatch.setattr(repeats, "HOT_ROWS", 100)
    rng, real = np.random.default_rng(4), repeats._meet

    def some(n):
        return "".join(map(chr, rng.integers(97, 123, n)))

    def lowest(x):
        return tc.window_hash(tc._BYTE[np.frombuffer(x.encode(), np.uint8)], 20).min()

    line = min((some(30) for _ in range(2000)), key=lowest)  # its gram is the sync point of most windows around it
    shared = some(60)
    rows = [(i, some(70) + line + (shared if i % 10 == 0 else some(60)) + some(30)) for i in range(400)]
    folder = str(tmp_path)

    def counting(*args):
        meet = real(*args)

        def run(table):
            n = sum(int(np.frombuffer(b.as_buffer(), np.int64, 2)[1]) for k, b in zip(table["kind"].to_pylist(), table["blob"]) if k)
            with open(f"{folder}/{table['part'][0].as_py()}", "w") as f:
                f.write(str(n))
            return meet(table)
        return run

    monkeypatch.setattr(repeats, "_meet", counting)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_removed) for r in suffix_dedup.op2_suffix_dedup(df).collect()}
    assert got == {(d, sum(g)) for (d, _), g in zip(rows, covered([(d, t.encode()) for d, t in rows], 50))}
    assert sum(n for _, n in got) > 0
    assert max(int(p.read_text()) for p in tmp_path.iterdir()) < 350


def test_all_grams_hot(messy, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_ROWS", 0)
    monkeypatch.setattr(repeats, "LEAST", 1)
    test_bytes_against_brute_force(messy)
    test_words_against_brute_force(messy)


def intervals(docs, target, first):
    got = doubling.find(docs, target, first).collect()
    assert len({(r.id, r.key) for r in got}) == len(got)
    return {r.id: sum(b - a for a, b in np.frombuffer(r.removed, np.int32).reshape(-1, 2).tolist()) for r in got}


def test_lengths_of_the_levels():
    assert doubling.lengths(50) == [13, 25, 50]
    assert doubling.lengths(50, 3) == [2, 4, 7, 13, 25, 50]
    assert doubling.lengths(50, 50) == [25, 50]
    assert doubling.lengths(2) == [1, 2] and doubling.lengths(1) == [1]
    for target in range(1, 70):
        steps = doubling.lengths(target, 5)
        assert steps[-1] == target and all(a < b <= 2 * a for a, b in zip(steps, steps[1:]))


@pytest.mark.parametrize("target, first, size", [(12, 2, 16 << 20), (12, 2, 60), (9, 3, 200), (2, 1, 60), (1, 1, 60)])
def test_levels_against_brute_force(spark, monkeypatch, target, first, size):
    """Few different words, so windows repeat within and across documents; slices of one document and of all."""
    monkeypatch.setattr(doubling, "SLICE", size)
    rng = np.random.default_rng(target)
    raw = [(i, [str(w) for w in rng.integers(0, 3, rng.integers(0, 40))]) for i in range(60)]
    raw += [(100 + i, raw[i][1] * 2) for i in range(8)]
    df = spark.createDataFrame([(d, " ".join(x)) for d, x in raw], "doc_id long, text string").repartition(3)
    want = {d: sum(g) for (d, _), g in zip(raw, covered(raw, target)) if sum(g)}
    assert intervals(df, target, first) == want


def test_no_candidate_survives(spark, monkeypatch):
    """Documents that share 20 words: the level of 25 has nothing left, the one of 50 is never built."""
    rng, built, real = np.random.default_rng(2), [], doubling._double

    def double(length, longer, *rest):
        built.append(longer)
        return real(length, longer, *rest)

    monkeypatch.setattr(doubling, "_double", double)
    same = " ".join(map(str, range(20)))
    df = spark.createDataFrame([(i, " ".join(map(str, rng.integers(100, 1 << 40, 60))) + " " + same) for i in range(30)],
                               "doc_id long, text string")
    assert intervals(df, 50, 13) == {} and built == [25]


def test_passage_of_every_document_costs_two_rows_a_slice(spark, monkeypatch):
    rng = np.random.default_rng(3)
    same = " ".join(map(str, range(60)))
    raw = [(i, same + " " + " ".join(map(str, rng.integers(100, 1 << 40, 10)))) for i in range(300)]
    df = spark.createDataFrame(raw, "doc_id long, text string").coalesce(1)
    scan = repeats.keyed(df).select("id", "key", "__text").mapInArrow(doubling._scan(13, 50, 4, 1 << 30), doubling._PACKED)
    rows = {}
    for r in scan.collect():
        if r.kind != doubling._DOCS:
            rows[r.kind] = rows.get(r.kind, 0) + int(np.frombuffer(r.blob, np.int64, 2)[1])
    assert rows[doubling._SHARED] == 2 * 48  # the passage's windows of 13 words
    assert rows[doubling._KEPT] == 298 * 48
    assert rows[doubling._OPEN] == 300 * 10
    assert intervals(df, 50, 13) == {i: 60 for i in range(1, 300)}


def test_repeated_rows_and_shared_ids(spark):
    a, b = " ".join(map(str, range(70))), " ".join(map(str, range(200, 280)))
    df = spark.createDataFrame([(1, a), (1, a), (1, a + " x"), (2, b + " " + a), (2, b + " " + a), (None, b), (None, b), (3, None)],
                               "doc_id long, text string")
    assert intervals(df, 50, 13) == {2: 70, repeats.NULL_ID: 80}


def test_doubling_round_trip():
    pos, ids, h = np.array([3, 4, 900], np.int32), np.array([-5, 9, repeats.NULL_ID]), np.array([1, 1 << 63, 5], np.uint64)
    for n in (3, 0):
        piece, *got = doubling._unpack(pa.scalar(doubling._pack(7 << 32, pos[:n], ids[:n], h[:n])), np.int32, np.int64, np.uint64)
        assert piece == 7 << 32
        assert [x.tolist() for x in got] == [x[:n].tolist() for x in (pos, ids, h)]
