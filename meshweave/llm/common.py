"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space, tab, LF, VT, FF and CR.
#: ``bytes.split()`` without arguments splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of one Arrow batch; a batch of long texts stays small.
ARROW_ROWS, ARROW_BYTES = 2_000, 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the tables, by its name, through Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes unless the session sets its own bound."""
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES),
    ):
        if spark.sparkContext.getConf().get(key) is None:
            spark.conf.set(key, str(value))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is missing (local runs, tests) a temporary folder
    of this machine is taken, and set as the checkpoint folder too.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        own = tempfile.TemporaryDirectory(prefix="meshweave-")
        atexit.register(own.cleanup)
        spark.sparkContext.setCheckpointDir(own.name)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage, by a reliable checkpoint.

    Every executor can read the copy, so a lost executor costs no recomputation. The files
    go with ``release``, or all together when the driver ends.
    """
    shared_dir(df.sparkSession)
    _clear_at_exit(df.sparkSession)
    return df.checkpoint(eager=True)


_CLEARED: set[str] = set()


def _clear_at_exit(spark: SparkSession) -> None:
    """Remove this application's own checkpoint folder when the driver ends."""
    own = spark.sparkContext.getCheckpointDir()
    if own and own not in _CLEARED:
        _CLEARED.add(own)
        atexit.register(_remove, spark, own)


def release(*frames: DataFrame) -> None:
    """Delete the files behind frames of ``cut`` and ``written`` that nothing will read again.

    The JVM is asked to collect garbage, upon which Spark deletes the shuffles that nothing refers to.
    """
    if frames:
        frames[0].sparkSession.sparkContext._jvm.System.gc()
    for df in frames:
        path = df.__dict__.get("_stored_at")
        if path is None:
            file = df._jdf.logicalPlan().rdd().getCheckpointFile()
            path = file.get() if file.isDefined() else None
        if path is not None:
            remove_path(df.sparkSession, path)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        remove_path(spark, path)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        pass


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path in the store that Spark's readers see."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Compute ``df`` once, as a Parquet table in the shared folder, and reread it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    return out


def text_of(column: str | Column) -> Column:
    """A text, null counting as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def n_words(column: str | Column) -> Column:
    """The number of words of a text, without an array of them in memory.

    Every word becomes one letter; what is left besides white space is counted.
    """
    marked = F.regexp_replace(text_of(column), WORD, "x")
    return F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("long")


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used, also within other functions."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Elements of an array that a running total handles together.
RUN = 32


def running(array: Column, value, join, start: int = 0) -> Column:
    """For each element of an array, ``join`` of ``start`` and the ``value`` of all before it (integers).

    Arrays can only be built by copying, so totals run over blocks of ``RUN`` elements first and then
    within each: the work grows in proportion to the array.
    """
    empty = F.array().cast("array<int>")

    def pushed(acc: Column, x: Column) -> Column:
        return F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def before(values: Column, at: Column) -> Column:
        return F.aggregate(values, F.struct(at.alias("at"), empty.alias("out")), pushed, lambda acc: acc["out"])

    def totals(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(start), join))
        return F.flatten(F.zip_with(blocks, before(sums, F.lit(start)), before))

    def blocked(values: Column) -> Column:
        count = F.ceil(F.size(values) / RUN).cast("int")
        return F.when(count < 2, before(values, F.lit(start))).otherwise(once(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.slice(values, (i - 1) * RUN + 1, F.lit(RUN))), totals))

    return once(F.transform(array, value), blocked)


#: A text is handled in parts of about this many bytes.
PART_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def parts(raw: bytes) -> Iterator[bytes]:
    """Cut a text at white space into parts of about ``PART_BYTES``."""
    start = 0
    while len(raw) - start > PART_BYTES:
        space = _SPACE.search(raw, start + PART_BYTES)
        if space is None:
            break
        yield raw[start : space.start()]
        start = space.end()
    yield raw[start:] if start else raw


#: The most rows, of a few numbers each, that a computed frame may have to be broadcast.
BROADCAST_ROWS = 150_000


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """``df`` (computed, cheap to count), broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def slices(pieces: Iterable, sizes: Iterable[int], most: int):
    """Group ``pieces`` in order so that each group's sizes sum to about ``most``."""
    group, total = [], 0
    for piece, size in zip(pieces, sizes):
        if group and total + size > most:
            yield group
            group, total = [], 0
        group.append(piece)
        total += size
    if group:
        yield group
