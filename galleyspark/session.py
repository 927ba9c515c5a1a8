"""Session helpers: defaults for local runs and the checkpoint folder of the cluster."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "galleyspark", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and benchmarks. Clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("galleyspark.text.partitions", str(shuffle_partitions))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where it is unset, a scratch folder serves one machine; a cluster gets an error."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` in the number of partitions that the session's ``galleyspark.text.partitions`` asks for; as it is where that is unset.

    Local sessions set it, as test tables are single row groups. Clusters leave it unset: no shuffle is added.
    """
    n = df.sparkSession.conf.get("galleyspark.text.partitions", None)
    return df.repartition(int(n)) if n else df


def dealt_rows(df: DataFrame) -> DataFrame:
    """``df`` dealt over the session's shuffle partitions, for narrow rows with much work each: a table of few bytes is one partition, however many rows it has."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
