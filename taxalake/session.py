"""Session helpers.

Library functions never build a session themselves; they take DataFrames.
These helpers are for tests, the bench and command-line jobs.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Session settings the jobs rely on. Static (estimate-based) broadcast is off:
# a join side is broadcast only by AQE, after its shuffle has measured it.
# AQE also coalesces small shuffle partitions and splits skewed join
# partitions at run time.
JOB_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    # AQE only merges shuffle partitions: start fine enough for TB-sized
    # shuffles, and let it coalesce small ones down to the advisory size.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8192",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
}


def job_session(app: str = "taxalake") -> SparkSession:
    """Session for spark-submit jobs: master and resources come from the
    submit command; JOB_CONF fills only settings the user did not set."""
    spark = SparkSession.builder.appName(app).getOrCreate()
    given = spark.sparkContext.getConf()
    for k, v in JOB_CONF.items():
        if not given.contains(k):
            spark.conf.set(k, v)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "taxalake") -> SparkSession:
    """A local session tuned like the tests and bench expect (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.autoBroadcastJoinThreshold", JOB_CONF["spark.sql.autoBroadcastJoinThreshold"])
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", JOB_CONF["spark.sql.adaptive.autoBroadcastJoinThreshold"])
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set (a folder every executor can reach); we
    never fall back to a machine-local temp folder there. Only a local-mode
    session (tests) gets its own folder when the setting is absent.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster session")
        d = tempfile.mkdtemp(prefix="taxalake-ckpt-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused path under the checkpoint folder, deleted when the session's JVM ends."""
    path = f"{checkpoint_root(spark)}/scratch/{name}-{uuid.uuid4().hex[:12]}"
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """A read-only input table. The DataFrame (file listing and footer schema)
    is kept on the session object and reused; every query still reads the
    files when it runs."""
    cache = spark.__dict__.setdefault("_taxalake_tables", {})
    path = table_path(sf_dir, name)
    if path not in cache:
        cache[path] = spark.read.parquet(path)
    return cache[path]


def spread(df: DataFrame, rows_per_task: int = 20_000) -> DataFrame:
    """``df`` dealt over tasks by its number of rows, for rows that cost far more to work on than to store.

    A scan is split by stored bytes, so a small file of rows that each become a long line is one task. A
    task gets at most ``rows_per_task`` rows, and every core some, if each then has a thousand."""
    rows = df.count()
    tasks = max(-(-rows // rows_per_task), min(df.sparkSession.sparkContext.defaultParallelism, rows // 1000))
    return df.repartition(tasks) if tasks > 1 else df
