"""PCA and K-Means over standardised profiles (J5, J6, F21, G3) with ``pyspark.ml``.

MLlib computes the covariance as a distributed tree-aggregate. All K-Means starts of a scan are iterated together: one pass over
the vectors adds up every start's clusters. Only model parameters (k x d numbers) and their sums reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.profiles import standardize
from flowlens.session import materialize


def assemble(df: DataFrame, cols, out: str = "features", scaled: bool = True) -> DataFrame:
    """Standardise ``cols`` (population std) and assemble them into a vector column."""
    cols = list(cols)
    z = standardize(df, cols) if scaled else df
    src = [c + "_z" for c in cols] if scaled else cols
    return VectorAssembler(inputCols=src, outputCol=out).transform(z)


def pca(df: DataFrame, cols, k: int = 4, key: str = "ip_source"):
    """Fit PCA on standardised features.

    Returns ``(scores, variance, loadings)`` DataFrames. Input is centred by the standardisation,
    so MLlib's uncentred projection equals the usual one. Each component's sign is fixed so its
    largest absolute loading is positive (PCA signs are otherwise arbitrary).
    """
    cols = list(cols)
    k = min(k, len(cols))
    vec = materialize(assemble(df, cols).select(key, "features"), "pca-input")
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(vec)
    pcm = model.pc.toArray()  # d x k, bounded by the parameters
    signs = np.where(pcm[np.abs(pcm).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    spark = df.sparkSession
    arr = vector_to_array("pc")
    scores = model.transform(vec).select(key, *[(arr[i] * float(signs[i])).alias(f"pc{i + 1}") for i in range(k)])
    ev = list(model.explainedVariance.toArray())
    variance = spark.createDataFrame(
        [(i + 1, float(v), float(np.sum(ev[: i + 1]))) for i, v in enumerate(ev)],
        "component int, explained_ratio double, cumulative double")
    loadings = spark.createDataFrame(
        [(c, j + 1, float(pcm[i, j] * signs[j])) for i, c in enumerate(cols) for j in range(k)],
        "feature string, component int, loading double")
    return scores, variance, loadings


#: Rows that starting centres are drawn from at most: those with the smallest hash.
START_ROWS = 8192
MAX_ITER = 300


def _matrix(batches) -> np.ndarray:
    """The vectors (first column) of Arrow batches."""
    import pyarrow as pa
    x = pa.Table.from_batches(batches).column(0).combine_chunks()
    return x.flatten().to_numpy().reshape(len(x), -1)


def start_centres(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++: every next centre is drawn with a chance in proportion to the squared distance from the nearest one so far."""
    rng = np.random.default_rng(seed)
    centres = points[[rng.integers(len(points))]]
    far = ((points - centres[0]) ** 2).sum(1)
    for _ in range(1, k):
        at = rng.choice(len(points), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(points))
        centres = np.vstack([centres, points[at]])
        far = np.minimum(far, ((points - points[at]) ** 2).sum(1))
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    far = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(2)
    own = far.argmin(1)
    return own, far[np.arange(len(x)), own]


def _sums(runs: dict[int, np.ndarray]):
    """For every run and cluster: rows, sum of vectors, sum of their squared lengths and of squared distances, over a task."""
    def run(batches):
        import pyarrow as pa
        acc: dict = {}
        for b in batches:
            every = _matrix([b])
            for lo in range(0, len(every), 4096):
                x = every[lo:lo + 4096]
                for i, centres in runs.items():
                    own, far = _nearest(x, centres)
                    k, d = centres.shape
                    got = acc.setdefault(i, np.zeros((k, d + 3)))
                    got[:, 0] += np.bincount(own, minlength=k)
                    got[:, 1] += np.bincount(own, (x * x).sum(1), k)
                    got[:, 2] += np.bincount(own, far, k)
                    for j in range(d):
                        got[:, 3 + j] += np.bincount(own, x[:, j], k)
        at = [(i, c, j) for i, g in acc.items() for c in range(g.shape[0]) for j in range(g.shape[1])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([a[n] for a in at], pa.int32()) for n in range(3)] + [pa.array([acc[i][c, j] for i, c, j in at], pa.float64())],
            ["run", "cluster", "j", "v"])
    return run


def _totals(vec: DataFrame, runs: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """One scan: the sums of all runs' clusters (a few thousand numbers)."""
    got = vec.select("x").mapInArrow(_sums(runs), "run int, cluster int, j int, v double")
    out = {i: np.zeros((len(c), c.shape[1] + 3)) for i, c in runs.items()}
    for r in got.groupBy("run", "cluster", "j").agg(F.sum("v").alias("v")).collect():
        out[r.run][r.cluster, r.j] = r.v
    return out


def lloyd(vec: DataFrame, starts: dict[int, np.ndarray], max_iter: int = MAX_ITER, tol: float = 1e-4,
          jobs: list | None = None) -> dict[int, tuple[np.ndarray, float]]:
    """(centres, cost) of every run. All runs move together, one scan of the vectors (``x``) for an iteration; a run stops when
    no centre moves by more than ``tol``. An empty cluster keeps its centre. With ``jobs``, an entry is added for each scan."""
    centres = {i: c.copy() for i, c in starts.items()}
    moving = set(centres)
    for _ in range(max_iter):
        if not moving:
            break
        got = _totals(vec, {i: centres[i] for i in sorted(moving)})
        if jobs is not None:
            jobs.append(len(moving))
        for i in list(moving):
            n = got[i][:, :1]
            new = np.where(n > 0, got[i][:, 3:] / np.maximum(n, 1), centres[i])
            if (((new - centres[i]) ** 2).sum(1) <= tol * tol).all():
                moving.discard(i)
            centres[i] = new
    if jobs is not None:
        jobs.append(len(centres))
    return {i: (centres[i], float(g[:, 2].sum())) for i, g in _totals(vec, centres).items()}


def silhouettes(vec: DataFrame, runs: dict[int, np.ndarray]) -> dict[int, float]:
    """Mean silhouette of every run under squared Euclidean distance, from cluster sums: two scans for all runs."""
    sums = _totals(vec, runs)

    def run(batches):
        import pyarrow as pa
        acc = {i: [0, 0.0] for i in runs}
        for b in batches:
            every = _matrix([b])
            for lo in range(0, len(every), 4096):
                x = every[lo:lo + 4096]
                for i, centres in runs.items():
                    n, sq, s = sums[i][:, 0], sums[i][:, 1], sums[i][:, 3:]
                    own, _ = _nearest(x, centres)
                    # sum of squared distances from each row to all rows of a cluster
                    total = (x * x).sum(1)[:, None] * n + sq - 2 * x @ s.T
                    rows = np.arange(len(x))
                    alone = n[own] <= 1
                    a = total[rows, own] / np.maximum(n[own] - 1, 1)
                    mean = np.where(n > 0, total / np.maximum(n, 1), np.inf)
                    mean[rows, own] = np.inf
                    near = mean.min(1)
                    top = np.maximum(a, near)
                    score = np.where(alone | (top <= 0) | ~np.isfinite(near), 0.0, (near - a) / np.where(top > 0, top, 1))
                    acc[i][0] += len(x)
                    acc[i][1] += score.sum()
        yield pa.RecordBatch.from_arrays([pa.array(list(acc), pa.int32()), pa.array([v[0] for v in acc.values()], pa.int64()),
                                          pa.array([v[1] for v in acc.values()], pa.float64())], ["run", "n", "s"])

    got = vec.select("x").mapInArrow(run, "run int, n long, s double").groupBy("run").agg((F.sum("s") / F.sum("n")).alias("m"))
    return {r.run: r.m for r in got.collect()}


def kmeans_input(df: DataFrame, cols, key: str = "ip_source") -> DataFrame:
    """``key, x``: the standardised features as an array, written once for all scans."""
    z = standardize(df, list(cols))
    return materialize(z.select(key, F.array(*[F.col(c + "_z").cast("double") for c in cols]).alias("x")), "kmeans-input")


def _starts(vec: DataFrame, ks, n_init: int, seed: int, key: str) -> dict[tuple[int, int], np.ndarray]:
    points = np.array([r.x for r in vec.orderBy(F.xxhash64(key), key).limit(START_ROWS).select("x").collect()])
    return {(k, r): start_centres(points, k, seed + r) for k in ks for r in range(n_init)} if len(points) else {}


def _best(vec: DataFrame, ks, n_init: int, seed: int, key: str, jobs: list | None = None) -> dict[int, tuple[np.ndarray, float]]:
    """Per k the run of least cost among ``n_init`` starts."""
    starts = _starts(vec, ks, n_init, seed, key)
    number = {i: k for i, (k, _) in enumerate(starts)}
    done = lloyd(vec, dict(enumerate(starts.values())), jobs=jobs)
    return {k: min((done[i] for i, kk in number.items() if kk == k), key=lambda cc: cc[1]) for k in ks if starts}


def assigned(vec: DataFrame, centres: np.ndarray, key: str) -> DataFrame:
    """Cluster id per key, in the row."""
    far = [sum(((F.get("x", F.lit(j)) - F.lit(float(v))) ** 2 for j, v in enumerate(c)), F.lit(0.0)) for c in centres]
    return vec.select(key, (F.array_position(F.array(*far), F.array_min(F.array(*far))) - 1).cast("int").alias("cluster"))


def kmeans_fit_scan(df: DataFrame, cols, kmax: int = 8, n_init: int = 10, seed: int = 42, key: str = "ip_source",
                    jobs: list | None = None):
    """Scan k = 2..kmax, ``n_init`` starts each, all iterated together.

    Returns ``(scan, k_best, models, vectors)``: inertia / silhouette per k, the k with the best silhouette, the best centres per k
    and the written feature vectors. The scans of the vectors are as many as the longest run has iterations, and three more.
    """
    vec = kmeans_input(df, cols, key)
    best = _best(vec, range(2, kmax + 1), n_init, seed, key, jobs)
    sil = silhouettes(vec, {k: c for k, (c, _) in best.items()}) if best else {}
    rows = [(k, cost, sil[k]) for k, (_, cost) in best.items()]
    scan = df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")
    k_best = max(rows, key=lambda r: (r[2], -r[0]))[0] if rows else 2
    return scan, k_best, {k: c for k, (c, _) in best.items()}, vec


def kmeans_scan(df: DataFrame, cols, kmax: int = 8, n_init: int = 10, seed: int = 42, key: str = "ip_source"):
    """Inertia and silhouette (squared Euclidean) for k = 2..kmax; ``(scan, k_best)``."""
    scan, k_best, _, _ = kmeans_fit_scan(df, cols, kmax, n_init, seed, key)
    return scan, k_best


def kmeans_assign(df: DataFrame, cols, k: int, n_init: int = 10, seed: int = 42, key: str = "ip_source") -> DataFrame:
    """Cluster id per key from the best of ``n_init`` starts."""
    vec = kmeans_input(df, cols, key)
    return assigned(vec, _best(vec, [k], n_init, seed, key)[k][0], key)


def cluster_profiles(df: DataFrame, assign: DataFrame, cols, key: str = "ip_source") -> DataFrame:
    """Mean raw feature values per cluster, 3 decimals."""
    return (df.join(assign, key).groupBy("cluster")
            .agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 3).alias(c) for c in cols]))


def cluster_projection(df: DataFrame, assign: DataFrame, cols, key: str = "ip_source") -> DataFrame:
    """Clusters on the first two principal axes (the cluster scatter): ``key, cluster, axis1, axis2``."""
    scores, _, _ = pca(df, cols, 2, key)
    return assign.join(scores, key).select(key, "cluster", F.col("pc1").alias("axis1"), F.col("pc2").alias("axis2"))


def project(z: DataFrame, cols, loadings: DataFrame, k: int, key: str = "ip_source") -> DataFrame:
    """Scores ``pc1..pck`` of standardised columns under given loadings (``feature, component, loading``; d x k rows)."""
    weight = {(r["feature"], r["component"]): r["loading"] for r in loadings.collect()}
    return z.select(key, *[sum((F.col(c + "_z") * F.lit(weight[c, j]) for c in cols), F.lit(0.0)).alias(f"pc{j}")
                           for j in range(1, k + 1)])


def assign_to(z: DataFrame, cols, centres: list[list[float]], key: str = "ip_source") -> DataFrame:
    """Cluster id per key: the nearest of the given centres (squared distance; ties to the smaller id), in the row."""
    far = [sum(((F.col(c + "_z") - F.lit(x)) ** 2 for c, x in zip(cols, centre, strict=True)), F.lit(0.0)) for centre in centres]
    return z.select(key, (F.array_position(F.array(*far), F.array_min(F.array(*far))) - 1).cast("int").alias("cluster"))
