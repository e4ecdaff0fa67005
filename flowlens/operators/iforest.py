"""Isolation Forest (J2, J3, F26, H13) — not in MLlib, so built from Spark pieces.

* Sampling: every row draws a hash-uniform number per tree; rows under a small rate are exploded
  into (tree, row) pairs and the psi smallest per tree are kept (a window with a literal bound, so
  each task pre-limits before the shuffle). Trees sample independently, by one formula at every n.
* Building: ``groupBy(tree).applyInPandas`` grows one isolation tree per group (numpy, <= psi rows).
* Scoring: the trees (trees x <= 2 psi nodes, bounded by the parameters) are shipped to the tasks and
  every partition is scored with ``mapInPandas`` — no shuffle of the scored data.

Score follows Liu et al. (2008): s = -2^(-E[h(x)] / c(psi)), lower is more anomalous; the cut-off is
the contamination quantile of the scores and a row is ``Suspect`` when strictly below it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators.topk import order_statistic
from flowlens.session import materialize

_EULER = 0.5772156649015329
NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, size long, depth int")


def c_factor(n) -> np.ndarray:
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + _EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    """Grow one isolation tree; returns node rows (node, feature, threshold, left, right, size, depth)."""
    nodes = []
    stack = [(np.arange(len(x)), 0, 0)]
    nodes.append(None)
    while stack:
        idx, depth, nid = stack.pop()
        sub = x[idx]
        if depth >= max_depth or len(idx) <= 1:
            nodes[nid] = (nid, -1, 0.0, -1, -1, len(idx), depth)
            continue
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if len(cand) == 0:
            nodes[nid] = (nid, -1, 0.0, -1, -1, len(idx), depth)
            continue
        f = int(rng.choice(cand))
        thr = float(rng.uniform(lo[f], hi[f]))
        left = idx[sub[:, f] < thr]
        right = idx[sub[:, f] >= thr]
        lid, rid = len(nodes), len(nodes) + 1
        nodes.extend([None, None])
        nodes[nid] = (nid, f, thr, lid, rid, len(idx), depth)
        stack.append((left, depth + 1, lid))
        stack.append((right, depth + 1, rid))
    return nodes


def _builder(cols: list[str], psi: int, seed: int):
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        x = pdf[cols].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, t])
        rows = _grow(x, rng, max_depth)
        out = pd.DataFrame(rows, columns=["node", "feature", "threshold", "left", "right", "size", "depth"])
        out.insert(0, "tree", t)
        return out.astype({"tree": "int32", "node": "int32", "feature": "int32", "left": "int32",
                           "right": "int32", "size": "int64", "depth": "int32"})
    return build


def _u01(key_cols, t):
    """Hash-uniform number in [0, 1) for (row key, tree)."""
    h = F.xxhash64(*[F.col(c) for c in key_cols], t)
    return (F.pmod(h, F.lit(1 << 40)).cast("double") / float(1 << 40))


def fit_trees(df: DataFrame, cols, key: str, trees: int = 100, psi: int = 256, seed: int = 42) -> pd.DataFrame:
    """Fit the forest; returns the node table (trees x <= 2 psi rows) as pandas for scoring."""
    cols = list(cols)
    n = df.count()
    psi = int(min(psi, n))
    rate = min(1.0, 4.0 * psi / max(n, 1))  # four times the rows needed: too few are out of the question
    pick = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: _u01([key], t + F.lit(seed * 1000003)) < F.lit(rate))
    ex = df.select(key, *cols, F.explode(pick).alias("tree"))
    ex = ex.withColumn("u", _u01([key], F.col("tree") + F.lit(seed * 1000003)))
    w = Window.partitionBy("tree").orderBy("u", key)
    sample = ex.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= F.lit(psi)).drop("rn", "u")
    nodes = sample.groupBy("tree").applyInPandas(_builder(cols, psi, seed), NODE_SCHEMA)
    return nodes.toPandas(), psi  # bounded: trees x (2 psi - 1) rows


def _scorer(nodes: pd.DataFrame, cols: list[str], psi: int, key: str):
    trees = []
    for _, g in nodes.sort_values(["tree", "node"]).groupby("tree"):
        g = g.set_index("node").sort_index()
        trees.append((g["feature"].to_numpy(), g["threshold"].to_numpy(), g["left"].to_numpy(),
                      g["right"].to_numpy(), g["size"].to_numpy(), g["depth"].to_numpy()))
    cpsi = float(c_factor([psi])[0]) or 1.0

    def score(it):
        for pdf in it:
            x = pdf[cols].to_numpy(dtype=float)
            total = np.zeros(len(x))
            for feat, thr, left, right, size, depth in trees:
                node = np.zeros(len(x), dtype=np.int64)
                active = feat[node] >= 0
                while active.any():
                    ids = np.flatnonzero(active)
                    nd = node[ids]
                    go_left = x[ids, feat[nd]] < thr[nd]
                    node[ids] = np.where(go_left, left[nd], right[nd])
                    active = feat[node] >= 0
                total += depth[node] + c_factor(size[node])
            eh = total / max(len(trees), 1)
            yield pd.DataFrame({key: pdf[key], "score": -np.power(2.0, -eh / cpsi)})
    return score


def isolation_forest(df: DataFrame, cols, key: str = "ip_source", trees: int = 100, contamination: float = 0.05,
                     seed: int = 42, psi: int = 256) -> DataFrame:
    """``key, score, status`` — status ``Suspect`` when the score is below the contamination quantile."""
    cols = list(cols)
    nodes, psi_eff = fit_trees(df, cols, key, trees, psi, seed)
    key_type = dict(df.dtypes)[key]
    schema = T.StructType([T.StructField(key, T._parse_datatype_string(key_type)), T.StructField("score", T.DoubleType())])
    scored = df.select(key, *cols).mapInPandas(_scorer(nodes, cols, psi_eff, key), schema)
    # scored once, read for the cut-off and by the caller
    return flag_suspects(materialize(scored, "forest-scores"), contamination)


def flag_suspects(scored: DataFrame, contamination: float = 0.05) -> DataFrame:
    """``status`` of scored rows: ``Suspect`` strictly below the exact contamination quantile of ``score``."""
    cut = F.lit(order_statistic(scored, "score", contamination)).cast("double")
    return scored.withColumn("status", F.when(F.col("score") < cut, "Suspect").otherwise("Normal"))


def anomaly_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count_if(F.col("status") == "Suspect").alias("n_suspect"),
                      F.count_if(F.col("status") == "Normal").alias("n_normal"),
                      F.round(F.avg((F.col("status") == "Suspect").cast("int")), 6).alias("suspect_rate"))


def score_histogram(scored: DataFrame, bins: int = 40) -> DataFrame:
    """Counts of scores per status in ``bins`` equal-width bins between the min and max score."""
    ends = scored.agg(F.struct(F.min("score").alias("lo"), F.max("score").alias("hi"))).scalar()
    lo, hi = ends["lo"], ends["hi"]
    b = F.least(F.width_bucket(F.col("score"), lo, hi + F.lit(1e-12), F.lit(bins)), F.lit(bins))
    return scored.groupBy("status", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
