"""Session construction and shared-storage helpers.

The library never creates a session behind the caller's back except through
``get_session`` (tests, bench, CLI).  Jobs that need to cut lineage or land an
intermediate file write under the folder the cluster names in
``spark.checkpoint.dir``; only when that setting is absent (local tests) do we
pick a fresh private folder and record it in the session.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_session(master: str | None = None, app: str = "revlens",
                shuffle_partitions: int | None = None, driver_memory: str | None = None) -> SparkSession:
    """Session with the settings the library is tuned for.

    Master and driver memory are set only where the caller names them, so a
    submitted application keeps those of ``spark-submit``.  AQE stays on so
    shuffle partitions coalesce for small inputs and skewed sort-merge
    partitions are split at run time; the UI is off (no server).
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master)
    if driver_memory is not None:
        builder = builder.config("spark.driver.memory", driver_memory)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir``; set a private folder only where the
    session has none (local runs and tests).
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - sessions without a local SparkContext (Spark Connect)
        sc = None
    if sc is None:
        root = spark.conf.get(CHECKPOINT_CONF, None)
        if not root:
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        return root
    current = sc.getCheckpointDir()
    if current:
        return current
    root = sc.getConf().get(CHECKPOINT_CONF, None)
    if not root:
        if not sc.master.startswith("local"):
            # a folder on the driver's disk is invisible to executors
            raise RuntimeError(f"set {CHECKPOINT_CONF} to shared storage every executor can reach")
        root = tempfile.mkdtemp(prefix="revlens-ckpt-")
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir() or root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


#: Removes a query's shuffle files when it ends.
SHUFFLE_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession):
    """Queries that end inside leave no shuffle files.

    Otherwise these stay until the driver happens to collect its garbage: a
    training of several rounds keeps those of all rounds.  For jobs that write
    their result: a plan run again afterwards has to shuffle again.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP_CONF, None)
    spark.conf.set(SHUFFLE_CLEANUP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP_CONF)
        else:
            spark.conf.set(SHUFFLE_CLEANUP_CONF, before)


def empty_table(spark: SparkSession, path: str, schema: str) -> None:
    """Free the space of a scratch table that nothing reads any more."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def distribute(df: DataFrame, key: str | None = None, min_partitions: int | None = None) -> DataFrame:
    """Spread a scan that has fewer partitions than the cluster has task slots.

    An input that arrives in enough splits is returned unchanged (no shuffle).
    An unsplittable file (one row group, one multi-line CSV) is
    hash-partitioned by ``key`` so the text work uses every core.  Only the
    placement of rows depends on this, never a result.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key) if key else df.repartition(target)


def keep(df: DataFrame, eager: bool = False) -> DataFrame:
    """Persist an intermediate that several branches of one job read.

    Memory first, disk when it does not fit; a lost executor's blocks are
    recomputed from lineage.  ``eager`` fills the cache with one job right
    away: otherwise the first query's concurrent branches (subqueries,
    broadcasts) can each start computing the same partitions before any is
    cached.
    """
    from pyspark import StorageLevel
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    if eager:
        kept.count()
    return kept
