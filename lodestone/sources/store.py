"""The index at rest: Parquet tables by repository, published as whole snapshots.

``<root>/<version>/{nodes,facts,edges,files,meta}`` and pointers ``CURRENT.<n>.<version>``,
of which the one with the highest number holds. A snapshot is written aside and published
by creating the next pointer, one atomic step, after which older pointers go: readers see
the old or the new one, and a failed write leaves only an unreferenced folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..vocab import EDGES, FACTS, FILES, NODES

SCHEMA_VERSION = "1"
TABLES = {"nodes": NODES, "facts": FACTS, "edges": EDGES, "files": FILES}
PARTITIONS = {"edges": ["repository", "kind"]}


class IncompatibleIndex(RuntimeError):
    pass


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- snapshots -------------------------------------------------------------

    def _pointers(self) -> list[tuple[int, str]]:
        """(number, version) of every pointer, the highest number last."""
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        parts = [n.split(".") for n in names if n.startswith("CURRENT.")]
        return sorted((int(p[1]), p[2]) for p in parts if len(p) == 3 and p[1].isdigit())

    def version(self) -> str | None:
        found = self._pointers()
        return found[-1][1] if found else None

    def write(self, nodes: DataFrame, facts: DataFrame, edges: DataFrame, files: DataFrame, meta: dict[str, str] | None = None) -> str:
        """Write and publish a snapshot; its version."""
        version = uuid.uuid4().hex
        for (name, schema), df in zip(TABLES.items(), (nodes, facts, edges, files), strict=True):
            columns = [F.col(f.name).cast(f.dataType) for f in schema.fields]
            df.select(*columns).write.partitionBy(*PARTITIONS.get(name, ["repository"])).parquet(f"{self.root}/{version}/{name}")
        rows = {"schema_version": SCHEMA_VERSION} | (meta or {})
        self.spark.createDataFrame(sorted(rows.items()), "key string, value string").coalesce(1).write.parquet(f"{self.root}/{version}/meta")
        self._publish(version)
        return version

    def _publish(self, version: str) -> None:
        older = self._pointers()
        number = older[-1][0] + 1 if older else 1
        if not self._fs.createNewFile(self._path(f"{self.root}/CURRENT.{number:012d}.{version}")):
            raise RuntimeError(f"{self.root}: snapshot {version} was published already")
        for n, v in older:
            self._fs.delete(self._path(f"{self.root}/CURRENT.{n:012d}.{v}"), False)

    def read(self, version: str | None = None) -> dict[str, DataFrame]:
        """The tables of a snapshot (the current one); another schema version raises."""
        version = version or self.version()
        if version is None:
            raise FileNotFoundError(f"no index under {self.root}")
        found = self.meta(version).get("schema_version")
        if found != SCHEMA_VERSION:
            raise IncompatibleIndex(f"index has schema {found}, this engine reads {SCHEMA_VERSION}: rebuild it")
        base = f"{self.root}/{version}"
        return {n: self.spark.read.schema(s).parquet(f"{base}/{n}").select(*s.fieldNames()) if self._fs.exists(self._path(f"{base}/{n}")) else self.spark.createDataFrame([], s) for n, s in TABLES.items()}

    def meta(self, version: str | None = None) -> dict[str, str]:
        rows = self.spark.read.parquet(f"{self.root}/{version or self.version()}/meta").collect()
        return {r["key"]: r["value"] for r in rows}

    # ---- upkeep ----------------------------------------------------------------

    def inspect(self) -> DataFrame:
        """(version, table, bytes, current) of every snapshot."""
        current, rows = self.version(), []
        for s in self._fs.listStatus(self._path(self.root)):
            if s.isDirectory():
                version = s.getPath().getName()
                for t in self._fs.listStatus(s.getPath()):
                    size = self._fs.getContentSummary(t.getPath()).getLength()
                    rows.append((version, t.getPath().getName(), size, version == current))
        return self.spark.createDataFrame(rows, "version string, table string, bytes long, current boolean")

    def prune(self) -> list[str]:
        """Delete every snapshot but the current one; the deleted versions."""
        current, gone = self.version(), []
        for s in self._fs.listStatus(self._path(self.root)):
            if s.isDirectory() and s.getPath().getName() != current:
                self._fs.delete(s.getPath(), True)
                gone.append(s.getPath().getName())
        return gone

    def compact(self, rows_per_file: int = 1_000_000) -> str:
        """Rewrite the current snapshot with fewer, larger files."""
        t, meta = self.read(), self.meta()
        sized = {n: df.repartition(max(1, -(-df.count() // rows_per_file)), "repository", "id" if "id" in df.columns else "path") for n, df in t.items()}
        return self.write(sized["nodes"], sized["facts"], sized["edges"], sized["files"], meta)

    def copy_from(self, other: Store) -> str:
        """Seed this store with another's current snapshot."""
        t = other.read()
        return self.write(t["nodes"], t["facts"], t["edges"], t["files"], other.meta() | {"seeded_from": other.root})
