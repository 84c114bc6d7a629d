"""Shared plumbing of the operators: the cluster's shared folder, lineage cuts,
deterministic splits and column hygiene."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import remove_dir, shared_dir, stored

__all__ = ["Recent", "crc_mod", "filesystem", "forgotten_with", "fresh_dir", "frugal", "hash_sample", "read_batches", "shared_dir", "stored", "table"]


def fresh_dir(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(remove_dir, spark, path)
    return path


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def read_batches(folder: str, rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a Parquet folder, at most ``rows`` at a time, read by a task."""
    fs, root = filesystem(folder)
    for info in sorted(fs.get_file_info(pafs.FileSelector(root)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(batch_size=rows)


def crc_mod(column: str | Column, modulus: int) -> Column:
    """``crc32(<column> as text) mod <modulus>``; null for a null column."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % F.lit(modulus)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Batches = Iterator[pa.RecordBatch]


#: What lets go of the memos that this process keeps for an operator's next task, and
#: the operator they are kept for.
_FORGET: list[Callable[[], object]] = []
_SERVED: list[str] = []


def forgotten_with(forget: Callable[[], object]) -> None:
    """Has ``forget`` called in a worker when another operator's task begins there."""
    _FORGET.append(forget)


def serve(operator: str) -> None:
    """Notes whose task begins in this worker. What it held for another operator goes:
    memos, and models that refer to themselves and wait for the collector."""
    if _SERVED != [operator]:
        for forget in _FORGET:
            forget()
        if _SERVED:
            gc.collect()
            release()
        _SERVED[:] = [operator]


def release() -> None:
    """Gives this process's free memory back."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def frugal(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A batch function that gives its worker's free memory back when a task ends, and
    what was kept for another operator when one begins: workers live as long as their
    executor, and their share of it is small."""
    operator = f"{run.__module__}.{run.__qualname__}"

    def wrapped(batches: Batches) -> Batches:
        serve(operator)
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


class Recent:
    """A memo, ``now``, of two generations: at ``most`` entries ``turn`` lets the older
    one go, so what is used often stays and what is held is bounded."""

    def __init__(self, most: int):
        self.most, self.now, self.older = most, {}, {}

    def turn(self) -> None:
        if len(self.now) > self.most:
            self.now, self.older = {}, self.now

    def miss(self, keys: set) -> set:
        """The keys that must be worked out and set; the others are there."""
        fresh = keys.difference(self.now)
        older = self.older
        if older and fresh:
            again = {k: older[k] for k in fresh if k in older}
            self.now.update(again)
            fresh = fresh.difference(again)
        return fresh


def hash_sample(df: DataFrame, keys: list[str], max_rows: int) -> DataFrame:
    """About ``max_rows`` rows of ``df`` at most, chosen by the hash of ``keys`` alone:
    the same rows on every run and partitioning. Rows with equal keys count once, so a
    row that repeats cannot fill the sample."""
    n = df.count()
    cut = int(min(1.0, max_rows / max(n, 1)) * (1 << 30))
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < F.lit(cut)).dropDuplicates(keys)
