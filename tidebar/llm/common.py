"""Shared-folder tables and distributed ranking used by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Separators of words: space and the ASCII controls tab to carriage return.
WORD_CLASS = r"[^\x20\x09-\x0D]+"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own in local mode (tests).

    On a cluster there is no such folder to invent, so an unset one is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (set_by_call := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = set_by_call.get()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tidebar-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_cleaned(spark: SparkSession):
    """Let Spark delete a job's shuffle files when its write is done; the setting returns to what it was."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back (survives lost executors)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _shuffles_cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialize`` wrote; for those that nothing reads any more, now or after a lost executor."""
    for t in tables:
        if path := getattr(t, "_path", None):
            jvm = t.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def sliced(batches, rows: int = 256):
    """Arrow batches of at most ``rows`` rows, so that a worker turns only so many texts into Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def ranked(df: DataFrame, groups: list[str], sub: Column, order: list, out: str) -> DataFrame:
    """Gapless 0-based rank of each row inside its group, by ``sub`` and then by ``order``.

    A group is sorted in pieces: one task sorts only the rows of one ``sub`` value, and a
    table of counts per (group, sub) gives each piece its start. ``df`` is read twice, the
    first time for the columns of the group and of ``sub`` alone.
    """
    df = df.withColumn("__sub", sub)
    keys = [*groups, "__sub"]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    local = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = [local[k].eqNullSafe(starts[f"__k{i}"]) for i, k in enumerate(keys)]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return local.join(starts, cond).withColumn(out, F.col("__start") + F.col("__rn") - 1).select(*(c for c in df.columns if c != "__sub"), out)


def id_bucket(col: Column) -> Column:
    """256 even buckets of an id: the first two hexadecimal digits of its MD5 (the same in any SQL engine)."""
    return F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("null"))), 1, 2)
