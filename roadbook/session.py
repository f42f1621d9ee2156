"""Session settings the operators count on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # no call-site capture per column expression: every micro-batch builds its plans anew
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

_LOCAL_FOLDER = "spark.roadbook.localFolder"


def open_session(app_name: str, master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above. Cluster sizes (shuffle partitions, memory) are left
    to the submitter; adaptive execution merges small shuffle partitions."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Put a session opened elsewhere on UTC, which all date and hour rules assume."""
    spark.conf.set("spark.sql.session.timeZone", _SETTINGS["spark.sql.session.timeZone"])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for stream checkpoints and working tables that all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset, as on a
    developer's machine in local mode, a temporary folder is made once per session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = spark.conf.get(_LOCAL_FOLDER, None) or tempfile.mkdtemp(prefix="roadbook-")
        spark.conf.set(_LOCAL_FOLDER, folder)
    return folder.rstrip("/")


def written_once(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back, so that several uses compute them once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
