"""Extraction: files to nodes, facts and diagnostics.

One narrow map over the files: each is parsed where it was read, and a parser that
fails costs its file a diagnostic, not the job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...vocab import DIAGNOSTICS, FACTS, NODES
from . import config, markdown, protobuf, python, scenes, sql, syntactic
from .builder import Result

Parser = Callable[[str, str, str], Result]


def parser_for(path: str) -> tuple[str, Parser] | None:
    """(language, parser) of the first frontend that takes the path."""
    name = path.rsplit("/", 1)[-1]
    for language in syntactic.LANGUAGES:
        if path.endswith(language.suffixes):
            return language.name, lambda r, p, t, lang=language: syntactic.parse(lang, r, p, t)
    if path.endswith(python.SUFFIXES):
        return "python", python.parse
    if name == "project.godot":
        return "godot", scenes.parse_project
    if path.endswith(".uid"):
        return "godot", scenes.parse_uid
    if path.endswith((".tscn", ".tres", ".escn")):
        return "godot", scenes.parse_scene
    if path.endswith(protobuf.SUFFIXES):
        return "protobuf", protobuf.parse
    if path.endswith(sql.SUFFIXES):
        return "sql", sql.parse
    if path.endswith(markdown.SUFFIXES):
        return "markdown", markdown.parse
    if config.is_manifest(path):
        return "manifest", config.parse_manifest
    if path.endswith(config.SUFFIXES) or name.startswith(".env"):
        return "config", config.parse
    return None


def parse_file(repository: str, path: str, text: str, adapters: list | None = None) -> Result:
    found = parser_for(path)
    if found is None:
        return Result()
    try:
        result = found[1](repository, path, text)
        if adapters:
            from ..effects import apply

            result = apply(adapters, found[0], text, result)
        return result
    except Exception as e:  # a parser's failure is evidence about its file
        return Result(diagnostics=[{"repository": repository, "path": path, "line": 1, "level": "error", "message": f"{type(e).__name__}: {e}"}])


_ROW = T.StructType([T.StructField("nodes", T.ArrayType(NODES)), T.StructField("facts", T.ArrayType(FACTS)), T.StructField("diagnostics", T.ArrayType(DIAGNOSTICS))])


def extract(files: DataFrame, adapters: list | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``files``: (repository, path, content) -> (nodes, facts, diagnostics). Files
    without a content are left out; ``adapters`` are the configured call effects. The parsed rows are kept in the shared folder,
    since three tables are read from them."""
    from ...plans.scratch import stored

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [parse_file(r, p, c, adapters) for r, p, c in zip(batch["repository"], batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame({"nodes": [r.nodes for r in rows], "facts": [r.facts for r in rows], "diagnostics": [r.diagnostics for r in rows]})

    parsed = stored(files.where("content is not null").select("repository", "path", "content").mapInPandas(run, _ROW), "parsed")
    return tuple(parsed.select(F.explode(c).alias("r")).select("r.*") for c in ("nodes", "facts", "diagnostics"))
