"""Session helpers: lineage cuts, sizes of broadcasts, and the settings the exact tests like."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted frame is broadcast.
BROADCAST_ROWS = 200_000

#: Without the first the generated method of a geometric join outgrows what the JVM compiles. The last two: a side is broadcast by the size it
#: turns out to have, never by the size of the files it comes from, as a few bytes of keys make whole meshes.
SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "2m",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply ``SETTINGS`` to a session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, removed when the driver ends."""
    path = f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        pass


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder; a local one only where none is set."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        own = tempfile.TemporaryDirectory(prefix="meshweave-")
        atexit.register(own.cleanup)
        context.setCheckpointDir(own.name)
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Compute once into the shared checkpoint folder."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame) -> DataFrame:
    """``df`` broadcast if, counted, it has few rows; as it is otherwise."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
