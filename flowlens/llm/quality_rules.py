"""Operator 8: quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per rule; policies are
versioned masks over these bits, so a policy change or an ablation needs no second look at the texts: verdicts are
``bits & mask = 0`` and ablations are bitwise sums over the distinct bit patterns (at most 2**rules rows).

Defined cases: a null or empty text has 0 words and fails ``few_words``; repeated rows give repeated ledger rows; a null
doc_id is carried along; an empty table gives an empty ledger; other input columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm import textcore as tc

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_stutter")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True

#: (rule, SQL condition under which it fails); the position is the rule's bit. Integer arithmetic only.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("shouting", "2 * n_upper > n_letters"),
    ("stutter", "100 * n_stutter > 25 * n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
]
#: Policy versions: the rules that reject. Bits of rules outside a policy stay in the ledger unused.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines", "shouting", "stutter", "word_length"),
}


def _count_same(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (document, key) pairs: which have an equal one before them in some order, and which have any equal one."""
    k = tc.mix(key + doc.astype(np.uint64) * tc.U(0xA0761D6478BD642F))
    order = np.argsort(k)
    same = k[order][1:] == k[order][:-1]
    later, many = np.zeros(len(k), bool), np.zeros(len(k), bool)
    later[order[1:][same]] = True
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    return later, many


def measure_batch(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of each document of a batch."""
    n = len(off) - 1
    starts, ends, wo = tc.words(data, off)
    inside = ~tc.IS_SPACE[data]
    out = {"n_words": np.diff(wo), "n_symbols": tc.sums(_SYMBOL[data], off),
           "word_chars": tc.sums(((data & 0xC0) != 0x80) & inside, off),
           "n_upper": tc.sums(_UPPER[data], off), "n_letters": tc.sums(_LETTER[data], off)}
    breaks = np.flatnonzero(data == 10)
    own = np.searchsorted(off, breaks, "right") - 1
    begins = np.sort(np.concatenate([off[:-1], breaks + 1]))
    doc = np.sort(np.concatenate([np.arange(n), own]))
    finish = np.sort(np.concatenate([off[1:], breaks]))
    full = np.concatenate([[0], np.cumsum(inside)])
    has = full[finish] > full[begins]
    begins, finish, doc = begins[has], finish[has], doc[has]
    later, _ = _count_same(doc, tc.span_hash(data, begins, finish))
    out["n_lines"] = np.bincount(doc, minlength=n)
    out["n_dup_lines"] = np.bincount(doc[later], minlength=n)
    at, own = tc.doc_starts(wo, WINDOW)
    word = tc.span_hash(data, starts, ends)
    same = np.zeros(len(word), bool)
    same[1:] = word[1:] == word[:-1]
    same[wo[:-1][wo[:-1] < wo[1:]]] = False
    out["n_stutter"] = tc.sums(same, wo)
    codes = tc.window_hash(word, WINDOW)
    _, many = _count_same(own, codes[at])
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, at[many], 1)
    np.add.at(change, at[many] + WINDOW, -1)
    out["n_repeat_words"] = tc.sums(np.cumsum(change)[:-1] > 0, wo)
    return out


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the named columns and the measurements (longs). No shuffle."""
    fields = [f for f in docs.select(*keep).schema.fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{m} long" for m in MEASURES])
    kept = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in tc.slices(batches, "__text"):
            got = measure_batch(data, off)
            yield pa.RecordBatch.from_arrays([rows.column(i) for i in range(len(kept))]
                                             + [pa.array(got[m].astype(np.int64)) for m in MEASURES], [*kept, *MEASURES])

    return docs.select(*kept, F.col("text").alias("__text")).mapInArrow(run, schema)


def mask(policy: str) -> int:
    """The bits that reject under a policy."""
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in POLICIES[policy])


def failure_bits() -> Column:
    """The ledger's bit column from the measurements."""
    return sum((F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, cond) in enumerate(RULES)),
               F.lit(0)).cast("long")


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measurements and failure bits of every document."""
    return measure(docs, keep).withColumn("failed_bits", failure_bits())


def verdict(policy: str) -> Column:
    """True where no rule of the policy failed."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(entries: DataFrame) -> DataFrame:
    """For each policy and rule: documents rejected, and those that only this rule rejects (they'd be kept without it).

    One pre-aggregation to the distinct bit patterns; everything after works on at most 2**rules rows.
    """
    patterns = entries.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    names = {name: i for i, (name, _) in enumerate(RULES)}
    picks = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(1 << names[r]).alias("bit"),
                               F.lit(mask(p)).alias("mask")) for p, rs in POLICIES.items() for r in rs])
    x = patterns.select("failed_bits", "n", F.explode(picks).alias("x")).select("failed_bits", "n", "x.*")
    hit = F.col("failed_bits").bitwiseAND(F.col("mask"))
    return x.groupBy("policy", "rule").agg(
        F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("rejected"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("only_by_this_rule"))


def op8_quality_rules(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The contract's digest of the ledger."""
    entries = ledger(docs)
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          (F.col("failed_bits").bitwiseAND(F.lit(mask("base"))) != 0).alias("base_failed"),
                          verdict(policy).alias("kept"))


def oracle(policy: str = "v1") -> str:
    """DuckDB SQL of the same result."""
    ws = "[^\\x20\\x09-\\x0D]+"
    fails = " OR ".join(f"({c})" for name, c in RULES if name in POLICIES[policy])
    base = " OR ".join(f"({c})" for name, c in RULES if name in POLICIES["base"])
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{ws}') AS ws FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i+{WINDOW - 1}], ' ') AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM rep) GROUP BY rid),
ln AS (SELECT rid, l FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{ws}')),
dup AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM ln GROUP BY rid),
m AS (SELECT rid, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        coalesce(n_lines, 0) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
        length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters,
        len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutter
      FROM w LEFT JOIN cov USING (rid) LEFT JOIN dup USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed, NOT ({fails}) AS kept FROM m"""


def keep(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The documents that pass the policy, with all their columns and nothing added.

    The measurement column names are prefixed away from the input's, so clashing names are safe.
    """
    cols = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)],
                        (F.col("text") if "text" in cols else F.lit(None).cast("string")).alias("text"))
    passed = ledger(plain, tuple(f"c{i}" for i in range(len(cols)))).where(verdict(policy))
    return passed.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])
