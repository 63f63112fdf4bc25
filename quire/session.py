"""Sessions: settings that the operators rely on, and how Python workers find this package."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
DEFAULT_BATCH, SMALL_BATCH = "67108864b", str(8 << 20)


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it (on a cluster: ship it with --py-files), and keep
    Arrow batches of long texts small: each is held several times over, by the executor and by its worker."""
    if spark.conf.get(BATCH) == DEFAULT_BATCH:
        spark.conf.set(BATCH, SMALL_BATCH)
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH"), ROOT]))
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return reachable(spark)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where its scan has fewer parts than that, as a small file of one row group has; else df."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
