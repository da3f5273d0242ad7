"""Session helpers: shared scratch folder, materialisation, size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """Session for tests and the local bench.  On a cluster use the one the platform gives you."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("qacorpus")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # local data is small and its text work heavy: do not merge it into one task
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor sees: ``spark.checkpoint.dir`` as the session gives it.

    Where that is unset a temporary folder is made and registered, but only for a local master: on a cluster every executor
    would write to its own disk.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-qacorpus-")
    context.setCheckpointDir(path)
    return context._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def write_out(df: DataFrame, kind: str = "stage", rows_per_file: int = 0) -> DataFrame:
    """Write Parquet to the shared folder and read it back.

    Cuts lineage, survives the loss of executors, and later steps read only the columns they need.  ``rows_per_file`` is for
    large rows, of which a task should not read many; 0 sets no limit.
    """
    path = new_path(df.sparkSession, kind)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Give CPU-heavy text work a task per core when a scan has fewer splits than that.

    A file with one row group is one task, however many cores there are.  Scans with enough splits, as on
    a cluster, are returned as they are, without a shuffle.  Only for plain scans: counting the splits of
    a plan with exchanges would run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(2 * cores, *keys)
