"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "quarry",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session with the settings every job here relies on.

    AQE is on (coalescing, skew-join splitting), the session clock is UTC
    (the DuckDB oracle is UTC-naive), Arrow batches are bounded so Python
    operators see fixed-size slices, and the UI server stays off.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # One BLAS thread per Python task: Spark already runs one task per core.
        "spark.executorEnv.OMP_NUM_THREADS": "1",
        "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
        "spark.executorEnv.MKL_NUM_THREADS": "1",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir`` (or one already set on the
    context). Only when neither is set -- local tests -- a private folder is
    created and registered.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="quarry-ckpt-", dir="/tmp")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def size_in_bytes(text) -> int:
    """Bytes of a Spark size setting: ``134217728b``, ``256MB``, ``1g`` (no unit: bytes)."""
    m = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", str(text).strip().lower())
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(m[1]) << (10 * " kmgtp".index(m[2] or " "))


def spread(df, min_partitions: int | None = None):
    """Give CPU-heavy narrow work (tokenising, scoring) at least the cluster's
    parallelism. The decision uses the optimizer's size estimate (no job runs):
    an input small enough to be read as fewer splits than there are cores is
    dealt round-robin; anything larger is left exactly as it is."""
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    split_bytes = size_in_bytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m"))
    try:
        est = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - no estimate: leave the plan alone
        return df
    return df.repartition(target) if est < split_bytes * target else df


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable in the Python workers (what ``--py-files`` does):
    the package is zipped once per application and added with ``addPyFile``, so
    Spark serves it to every executor. Operators that run Python in tasks need it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile

    import quarry
    root = os.path.dirname(os.path.abspath(quarry.__file__))
    fd, path = tempfile.mkstemp(prefix=f"quarry-{uuid.uuid4().hex[:8]}-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
