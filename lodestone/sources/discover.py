"""Files of a project: discovery, bounded reading and content hashes."""

from __future__ import annotations

import hashlib
import os
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import in_scope

# Folders that are never part of a project.
IGNORED = (".git", "node_modules", "vendor", ".venv", "venv", "__pycache__", "dist", "build", "target", ".godot", ".idea", ".vscode")
MOST_BYTES = 5 << 20
CONFIG_NAMES = (".lodestone.yaml", ".lodestone.yml")
SECTIONS = ("components", "index", "sql", "tests", "http", "adapters")


def project(root: str) -> dict[str, str]:
    """Root, branch, commit and origin of a checkout; '' where git has no answer."""

    def git(*args: str) -> str:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=60)
        return done.stdout.strip() if done.returncode == 0 else ""

    top = git("rev-parse", "--show-toplevel") or str(Path(root).resolve())
    return {"root": top, "branch": git("rev-parse", "--abbrev-ref", "HEAD"), "commit": git("rev-parse", "HEAD"), "origin": git("config", "--get", "remote.origin.url")}


def load_config(text: str) -> dict:
    """The project's configuration; unknown sections and malformed components or
    globs raise before anything is written."""
    data = yaml.safe_load(text) or {}
    if not isinstance(data, dict) or set(data) - set(SECTIONS):
        raise ValueError(f"configuration sections are {SECTIONS}")
    names: set[str] = set()
    for c in data.get("components", []):
        if not isinstance(c, dict) or not c.get("name") or not c.get("root"):
            raise ValueError("a component has a name and a root")
        if c["name"] in names:
            raise ValueError(f"component {c['name']!r} is named twice")
        names.add(c["name"])
    index = data.get("index", {})
    for key in ("include", "exclude"):
        globs = index.get(key, [])
        if not isinstance(globs, list) or any(not isinstance(g, str) or g.startswith("/") or ".." in g.split("/") for g in globs):
            raise ValueError(f"index.{key} is a list of relative globs")
    if "adapters" in data:
        from .effects import load_adapters

        data["adapters"] = load_adapters(data["adapters"])
    return data


def checkout_files(top: str) -> set[str] | None:
    """Paths that git tracks or would track (its ignore rules applied); None where
    ``top`` is no checkout."""
    done = subprocess.run(["git", "-C", top, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, timeout=600)
    return set(done.stdout.decode("utf-8", "surrogateescape").split("\0")) - {""} if done.returncode == 0 else None


def list_files(spark: SparkSession, root: str) -> list[tuple[str, str, int, int]]:
    """(uri, path, size, modified_ns) of every file outside ignored folders, hidden
    files too (Spark's own file source leaves those and ``__init__.py`` out). In a
    checkout only what git tracks, or would track by its ignore rules."""
    base = root.rstrip("/")
    if "://" not in base or base.startswith("file://"):
        top, out = base.removeprefix("file://"), []
        tracked = checkout_files(top)
        for folder, folders, names in os.walk(top):
            folders[:] = sorted(f for f in folders if f not in IGNORED)
            for n in sorted(names):
                full = os.path.join(folder, n)
                if os.path.isfile(full) and not os.path.islink(full) and (tracked is None or os.path.relpath(full, top) in tracked):
                    st = os.stat(full)
                    out.append((f"file://{os.path.abspath(full)}", os.path.relpath(full, top), st.st_size, st.st_mtime_ns))
        return out
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top, found, out = fs.getFileStatus(path).getPath().toString(), fs.listFiles(path, True), []
    while found.hasNext():
        f = found.next()
        uri = f.getPath().toString()
        here = uri[len(top) :].lstrip("/")
        if not set(here.split("/")[:-1]) & set(IGNORED):
            out.append((uri, here, f.getLen(), f.getModificationTime() * 1_000_000))
    return out


def read_files(spark: SparkSession, root: str, repository: str, include: list[str] | None = None, exclude: list[str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(repository, path, content, size, modified_ns, hash, skipped): every file in
    scope. The listing is the driver's, the reading the executors'. Oversize and
    binary files are listed with a reason and no content."""
    listed = spark.createDataFrame(list_files(spark, root), "uri string, path string, size long, modified_ns long")
    scope = in_scope(F.col("path"), include or [], exclude or []) | F.col("path").isin(*CONFIG_NAMES)
    listed = listed.where(scope).repartition(max(1, spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        for batch in batches:
            rows = []
            for uri, path, size, modified in batch.itertuples(index=False):
                content, digest, skipped = None, "", "oversize" if size > most_bytes else None
                if skipped is None:
                    try:
                        fs, inner = pafs.FileSystem.from_uri(uri) if not uri.startswith("file://") else (pafs.LocalFileSystem(), uri.removeprefix("file://"))
                        with fs.open_input_stream(inner, compression=None) as f:
                            data = f.read()
                        digest = hashlib.sha256(data).hexdigest()
                        skipped = "binary" if b"\0" in data[:8000] else None
                        content = data.decode("utf-8", "replace") if skipped is None else None
                    except OSError:
                        skipped = "unreadable"
                rows.append((repository, path, content, size, modified, digest, skipped))
            yield pd.DataFrame(rows, columns=["repository", "path", "content", "size", "modified_ns", "hash", "skipped"])

    return listed.mapInPandas(run, "repository string, path string, content string, size long, modified_ns long, hash string, skipped string")


def components(spark: SparkSession, files: DataFrame, repository: str, config: dict, about: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, facts) of the workspace: the repository and its files, its components, and
    which files each contains (root ``.``, the file itself, or a folder prefix).
    ``about`` are properties of the repository, such as its branch and commit."""
    from ..functions.ids import py_stable_id, stable_id
    from ..vocab import FACTS, NODES, WORKSPACE_OWNER

    def node(kind: str, name: str, qualified: str, properties: dict[str, str] | None = None) -> tuple:
        return (repository, py_stable_id("n", kind, qualified), kind, name, qualified, "", "", 0, 0, 0, properties or {}, WORKSPACE_OWNER, False)

    parts = [(c["name"], c["root"].strip("/") or ".") for c in config.get("components", [])]
    repo = node("repository", repository, f"repository:{repository}", {k: v for k, v in (about or {}).items() if v})
    own = [node("component", n, f"component:{repository}:{n}") for n, _ in parts]
    nodes = spark.createDataFrame([repo, *own], NODES)
    roots = spark.createDataFrame([(c[1], root) for c, (_, root) in zip(own, parts, strict=True)], "component string, root string")
    # The roots are the configuration's, a few.
    inside = (F.col("root") == ".") | (F.col("path") == F.col("root")) | F.startswith(F.col("path"), F.concat("root", F.lit("/")))
    held = files.select("path").join(F.broadcast(roots), inside).select(F.col("component").alias("a"), stable_id("n", "file", F.concat(F.lit(f"{repository}:"), "path")).alias("b"))
    top = spark.createDataFrame([(repo[1], c[1]) for c in own], "a string, b string")
    # The repository contains its files, as each component contains its own.
    every = files.select(F.lit(repo[1]).alias("a"), stable_id("n", "file", F.concat(F.lit(f"{repository}:"), "path")).alias("b"))
    pairs = held.unionByName(top).unionByName(every)
    facts = pairs.select(
        F.lit(repository).alias("repository"), stable_id("f", WORKSPACE_OWNER, F.col("a"), "contains", F.col("b"), "0", "0").alias("id"), F.col("a").alias("from_id"), F.lit("").alias("source"), F.lit("").alias("source_kind"),
        F.lit("contains").alias("kind"), F.lit("workspace").alias("producer"), F.col("b").alias("target_id"), F.lit("").alias("target"), F.lit("").alias("target_kind"), F.lit("").alias("path"), F.lit(0).alias("line"), F.lit(0).alias("column_no"), F.lit(0).alias("end_line"),
        F.create_map().cast("map<string,string>").alias("properties"), F.lit(WORKSPACE_OWNER).alias("owner_file"),
    )
    return nodes, facts.select(*FACTS.fieldNames())
