"""Session settings shared by tests, the bench and small local runs."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "ledgerspan", cpus: str | None = None) -> SparkSession:
    """A local session. On a cluster, use the session you are given instead."""
    n = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LEDGERSPAN_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a scratch one only where none is set."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def stage_root(spark: SparkSession) -> str:
    """A new folder for stage tables on shared storage; the caller of a job clears `<checkpoint folder>/stages` afterwards."""
    return f"{checkpoint_dir(spark).rstrip('/')}/stages/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, *keys: str, path: str | None = None) -> DataFrame:
    """Write a table once on shared storage and read it back: a lost executor replays no plan, and readers prune columns and rows.

    With keys, the table lies in one bucket of them per shuffle partition of the session. Readers then start clustered on the keys, so
    that joins and groupings on these and more columns move no row. The session's own catalog names the table only until it is read
    back; a metastore that outlives the session is left alone, and the table is then plain."""
    spark, path = df.sparkSession, path or stage_root(df.sparkSession)
    if not keys or spark.conf.get("spark.sql.catalogImplementation") != "in-memory":
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    name = f"spark_catalog.default.stage_{uuid.uuid4().hex}"
    with joins_keep_clustering(spark):
        df.write.mode("overwrite").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).format("parquet").option("path", path).saveAsTable(name)
    out = spark.table(name).select(df.columns)
    spark.sql(f"DROP TABLE {name}")  # of an outside table the files stay
    return out


@contextmanager
def joins_keep_clustering(spark: SparkSession):
    """While a table is written: a join on the clustering key and more columns moves neither side. The session's own setting comes back."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, "true")
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
