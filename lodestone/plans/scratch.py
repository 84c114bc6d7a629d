"""Lineage cuts in the folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffle files go when the execution that wrote them ends, not when the driver
#: happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows up to which a stored table is broadcast to a join.
SMALL = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a temporary one, which only
    a local master can share with its executors."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def remove_dir(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended; the folder is scratch
        pass


#: The paths that each open ``passing`` block has stored, the innermost last.
_PASSING: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside are removed when the block ends."""
    mine: list[str] = []
    _PASSING.append(mine)
    try:
        yield
    finally:
        _PASSING.remove(mine)
        for path in mine:
            remove_dir(spark, path)


def stored(df: DataFrame, tag: str, lasting: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back; removed when
    the driver ends, or before, if not ``lasting``, the innermost ``passing`` block."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(remove_dir, spark, path)
    if _PASSING and not lasting:
        _PASSING[-1].append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)  # ids are hex digits: half as long
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def kept_small(df: DataFrame, tag: str) -> DataFrame:
    """``df`` stored, and marked for broadcast if it has at most ``SMALL`` rows, so that
    the other side of a join is not shuffled for it."""
    kept = stored(df, tag)
    return F.broadcast(kept) if kept.limit(SMALL + 1).count() <= SMALL else kept
