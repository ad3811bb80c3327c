"""Session settings the engine expects; all of them can be overridden by the caller."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tallycast", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution, skew handling and UTC, for jobs, bench and tests."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that a frame reads; 0 where it reads none, such as after a checkpoint."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)) for file in df.inputFiles()]
    return sum(path.getFileSystem(conf).getFileStatus(path).getLen() for path in paths)


def checkpoint_folder(spark: SparkSession) -> None:
    """Use the shared folder of spark.checkpoint.dir. Where that is unset a local session gets a folder of its own; on a
    cluster executors would not see such a folder, so it is an error there."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


def cut_lineage(spark: SparkSession, df):
    """Checkpoint in the shared folder (see ``checkpoint_folder``)."""
    checkpoint_folder(spark)
    return df.checkpoint()
