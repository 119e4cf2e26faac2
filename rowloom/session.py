"""Session defaults and the shared folder for written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Where the tables that ``written`` returned lie.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def get_session(app_name: str = "rowloom", **conf: str) -> SparkSession:
    """A session with the library's defaults; anything passed in ``conf`` wins.

    The master, executor sizes and shuffle partitions stay with the cluster.
    """
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without one gets a fresh temporary folder; on a cluster it would be another
    folder on every machine, so there the setting is asked for.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="rowloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage in a way that survives the loss of executors, and keeps costly or
    non-deterministic stages from running again for every use.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[found] = path
    return found


def discard(*frames: DataFrame) -> None:
    """Frees the space of tables that ``written`` returned, once all that reads them is written itself.

    The table is overwritten by an empty one, which works in every store that Spark writes to.
    """
    for df in frames:
        path = _PATHS.pop(df, None)
        if path:
            df.sparkSession.range(0, numPartitions=1).write.mode("overwrite").parquet(path)
