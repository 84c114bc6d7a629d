"""Bounded text search and source excerpts over line-addressed content.

Lines are split in the scan's task and only lines with a hit leave it; the caps are
windows over the one deterministic scan order, so they cut the same hits whatever
the partitioning is."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNSUPPORTED = re.compile(r"\(\?(?:=|!|<=|<!|P=)|\\[1-9]")


def checked_patterns(patterns: list[str], regex: bool) -> list[str]:
    """At most 64 non-empty patterns of at most 1,024 bytes, unique and sorted; of
    expressions, those without look-around and back-references."""
    wanted = sorted(set(patterns))
    if not wanted or len(wanted) > 64 or any(not p or len(p.encode()) > 1024 for p in wanted):
        raise ValueError("one to 64 patterns of one to 1,024 bytes")
    for p in wanted if regex else ():
        if UNSUPPORTED.search(p):
            raise ValueError(f"look-around and back-references are not supported: {p!r}")
        re.compile(p)
    return wanted


def line_hits(files: DataFrame, patterns: list[str], regex: bool = False, ignore_case: bool = False, most_bytes: int = 5 << 20) -> DataFrame:
    """``files``: (repository, path, content) -> repository, path, line, column,
    pattern, text. Columns count bytes from 1; hits of a pattern on a line do not
    overlap. Files with a NUL in the first 8,000 bytes or over ``most_bytes`` are
    skipped (see :func:`skipped`)."""
    wanted = checked_patterns(patterns, regex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(p, re.compile(p if regex else re.escape(p), re.IGNORECASE if ignore_case else 0)) for p in wanted]
        for batch in batches:
            rows = []
            for repository, path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for number, line in enumerate((content or "").split("\n"), 1):
                    for p, c in compiled:
                        for m in c.finditer(line):
                            if m.end() > m.start():
                                rows.append((repository, path, number, len(line[: m.start()].encode()) + 1, p, line))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["repository", "path", "line", "column_no", "pattern", "text"])

    read = files.where(skip_reason(most_bytes).isNull()).select("repository", "path", "content")
    # The JVM drops files without a literal before any row reaches Python.
    if not regex and not ignore_case:
        some = F.lit(False)
        for p in wanted:
            some = some | F.contains("content", F.lit(p))
        read = read.where(some)
    return read.mapInArrow(run, "repository string, path string, line int, column_no int, pattern string, text string")


def skip_reason(most_bytes: int = 5 << 20):
    c = F.col("content")
    return F.when(c.isNull(), "unreadable").when(F.octet_length(c) > most_bytes, "oversize").when(F.instr(F.substring(c, 1, 8000), "\0") > 0, "binary")


def skipped(files: DataFrame, most_bytes: int = 5 << 20) -> DataFrame:
    """(reason, count) of the files that a search leaves out."""
    return files.select(skip_reason(most_bytes).alias("reason")).where("reason is not null").groupBy("reason").count()


def search(files: DataFrame, patterns: list[str], regex: bool = False, ignore_case: bool = False, total: int = 100, per_pattern: int = 50, per_file: int = 10, most_bytes: int = 32 << 10, context: int = 0) -> DataFrame:
    """Capped hits in the order repository, path, line, pattern, column, with
    ``truncated``. A match costs its strings' bytes, 64 and 4 a context line; the
    first is always kept."""
    total, per_pattern, per_file = min(total, 500), min(per_pattern, 200), min(per_file, 50)
    context, most_bytes = min(max(context, 0), 20), min(most_bytes, 256 << 10)
    order = ["repository", "path", "line", "pattern", "column_no"]
    hits = line_hits(files, patterns, regex, ignore_case)
    number = lambda *g: F.row_number().over(Window.partitionBy(*g).orderBy(*order))
    kept = hits.withColumn("_f", number("repository", "path")).where(F.col("_f") <= per_file + 1)
    cut = F.max("_f").over(Window.partitionBy("repository", "path")) > per_file
    kept = kept.withColumn("_cut", cut).where(F.col("_f") <= per_file)
    # At most the total of each pattern can be shown: a top-k before the last window.
    kept = kept.withColumn("_p", number("pattern")).where(F.col("_p") <= per_pattern)
    kept = kept.orderBy(*order).limit(total + 1)
    cost = F.octet_length("repository") + F.octet_length("path") + F.octet_length("pattern") + F.octet_length("text") + 64 + 4 * 2 * context
    everything = Window.partitionBy(F.lit(1)).orderBy(*order)  # at most total + 1 rows
    kept = kept.withColumns({"_n": F.row_number().over(everything), "_b": F.sum(cost).over(everything)})
    fits = (F.col("_n") <= total) & ((F.col("_n") == 1) | (F.col("_b") <= most_bytes))
    flag = F.max((~fits) | F.col("_cut")).over(Window.partitionBy(F.lit(1)))
    return kept.withColumn("truncated", flag).where(fits).select(*order, "text", "truncated")


def excerpt(nodes: DataFrame, edges: DataFrame, files: DataFrame, context: int = 2, most_lines: int = 200) -> DataFrame:
    """(id, line, text, truncated): the lines of each node with context. A generated
    method shows the query it is generated from, if that is one."""
    context, most_lines = min(max(context, 0), 20), min(max(most_lines, 1), 1000)
    queries = nodes.where("kind = 'sql_query' and not external").select(F.col("id").alias("to_id"))
    made = edges.where("kind = 'generated_from'").join(queries, "to_id", "left_semi").groupBy(F.col("from_id").alias("id")).agg(F.count_distinct("to_id").alias("n"), F.min("to_id").alias("shown"))
    asked = nodes.select("id").distinct().join(made.where("n = 1"), "id", "left").select("id", F.coalesce("shown", "id").alias("shown"))
    place = nodes.select(F.col("id").alias("shown"), "repository", "path", "line", "end_line").distinct()
    spans = asked.join(place, "shown").withColumns({"a": F.greatest(F.lit(1), F.col("line") - context), "b": F.greatest("line", "end_line") + context})
    lines = spans.join(files.select("repository", "path", "content"), ["repository", "path"])
    # Only the span is exploded, not the file.
    text = F.slice(F.split("content", "\n"), F.col("a"), F.least(F.col("b") - F.col("a") + 1, F.lit(most_lines)))
    cut = F.col("b") - F.col("a") + 1 > most_lines
    return lines.select("id", "a", cut.alias("truncated"), F.posexplode(text).alias("i", "text")).select("id", (F.col("a") + F.col("i")).alias("line"), "text", "truncated")
