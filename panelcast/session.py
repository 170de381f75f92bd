"""Session builder and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(
    master: str = "local[*]",
    app: str = "panelcast",
    shuffle_partitions: int = 8,
    memory: str = "8g",
) -> SparkSession:
    """A session for tests and benches; a cluster job brings its own."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local path would be lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="panelcast-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/panelcast/{name}-{uuid.uuid4().hex}"


def write_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A Parquet table below the shared folder, read back."""
    path = fresh_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `write_table` or `materialise` wrote, once nothing reads them any more."""
    for table in tables:
        path = table.__dict__.get("stored_at")
        if path:
            remove_folder(table.sparkSession, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever the path's file system is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialise(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A table below the shared folder, read back: used many times, lost with no executor.

    Rows are spread evenly first, by the rebalance hint, so adaptive execution sizes the parts by the data: a layout by
    series would leave most tasks idle, and many small parts make the sums that forests exchange per part the larger cost.
    """
    return write_table(spark, df.hint("rebalance"), name)
