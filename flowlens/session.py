"""Session construction and the shared work folder.

On a cluster the shared folder is whatever ``spark.checkpoint.dir`` names; we only set our own
(a fresh local temp folder) when the session has none, which is the local-test case.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "flowlens",
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings this library assumes.

    UTC session time zone (batch flows are ``timestamp_ntz`` anyway), AQE on with partition
    coalescing and skew-join splitting, Arrow for the few pandas paths, RocksDB streaming state
    store, UI off.
    """
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         # streaming state (windows, sessions, dedup keys) in RocksDB, off the JVM heap
         .config("spark.sql.streaming.stateStore.providerClass",
                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false"))
    if master:
        b = b.master(master)
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    work_dir(spark)
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` (set by the cluster), else the folder given to
    ``SparkContext.setCheckpointDir``. Only when both are unset and the master is local, a private
    temp folder becomes the checkpoint dir (local runs and tests); on a cluster that is an error,
    since executors would each write to a disk of their own. Also makes sure the package is
    importable by the Python workers (``ship_package``).
    """
    sc = spark.sparkContext
    d = spark.conf.get(_CKPT_KEY, None) or sc.getCheckpointDir()
    if not d:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="flowlens-ckpt-")
        spark.conf.set(_CKPT_KEY, d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    ship_package(spark, d)
    return d


_SHIPPED: set = set()


def ship_package(spark: SparkSession, folder: str | None = None) -> None:
    """Send this package to the executors once per application (``SparkContext.addPyFile``).

    The grouped / mapped pandas stages (isolation forest) run functions of this package inside
    Python workers, which must be able to import it wherever the driver was started from. The zip
    goes to the shared work folder when that is a local path; Spark then serves it to every
    executor (including ones started later).
    """
    import os
    import zipfile
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    base = folder if folder and is_local_path(folder) else tempfile.mkdtemp(prefix="flowlens-pkg-")
    base = base.replace("file:", "")
    os.makedirs(base, exist_ok=True)
    target = os.path.join(base, f"flowlens-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(target)
    _SHIPPED.add(app)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared work folder."""
    base = work_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def is_local_path(p: str) -> bool:
    return "://" not in p or p.startswith("file:")


def ensure_dir(p: str) -> str:
    if is_local_path(p):
        os.makedirs(p.replace("file:", ""), exist_ok=True)
    return p


def materialize(df, name: str = "stage"):
    """Cut lineage by writing ``df`` as a parquet table in the shared work folder and reading it
    back: one job (a reliable ``checkpoint()`` computes its plan twice), and the table survives
    the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
