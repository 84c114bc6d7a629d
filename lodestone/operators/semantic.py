"""Vector ranking of reusable declarations, and the embedding cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_identifier, under_prefix
from ..plans.scratch import stored

DOCUMENT_VERSION = "1"


def document(kind: Column, name: Column, qualified: Column, language: Column, properties: Column) -> Column:
    """The text that stands for a declaration: kind, name, the words of its qualified
    name, its language and its sorted properties, one a line."""
    keys = F.array_sort(F.map_keys(properties))
    lines = F.transform(keys, lambda k: F.concat(k, F.lit(" "), F.element_at(properties, k)))
    head = F.array(kind, name, split_identifier(qualified), F.concat(F.lit("language "), language))
    return F.array_join(F.concat(head, lines), "\n")


def content_hash(text: Column) -> Column:
    return F.sha2(F.concat(F.lit(DOCUMENT_VERSION + "\0"), text), 256)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed in order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """Unit length; raises on empty, zero or non-finite vectors."""
    norm = F.sqrt(dot(v, v))
    good = (F.size(v) > 0) & (norm > 0) & (norm < float("inf")) & ~F.isnan(norm)
    checked = F.when(good, norm).otherwise(F.raise_error(F.lit("a vector without a direction")).cast("double"))
    return F.transform(v, lambda x: (x / checked).cast("float"))


def top_k(vectors: DataFrame, query: list[float], k: int = 5, tie: list[str] | None = None) -> DataFrame:
    """The k vectors nearest to one query vector by inner product. One narrow pass
    and a bounded heap per task; the query is a literal."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("score", dot(F.col("vector"), q)).orderBy(F.desc("score"), *(tie or ["qualified_name", "id"])).limit(k)


def reusable(nodes: DataFrame, embeddings: DataFrame, query: list[float], languages: list[str] | None = None, prefixes: list[str] | None = None, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(matches, status): candidates with an embedding, best first, and how much of
    the candidates the cache covers. Under nine tenths the index is ``warming``;
    missing vectors make the answer ``partial``."""
    c = nodes.where(under_prefix(F.col("path"), prefixes or []))
    if languages:
        c = c.where(F.lower("language").isin(*[x.lower() for x in languages]))
    c = c.withColumn("content_hash", content_hash(document(F.col("kind"), F.col("name"), F.col("qualified_name"), F.col("language"), F.col("properties"))))
    both = c.join(embeddings.select("content_hash", "vector"), "content_hash", "left")
    counts = both.agg(F.count("*").alias("candidates"), F.count("vector").alias("covered"))
    share = F.when(F.col("candidates") == 0, 1.0).otherwise(F.floor(F.col("covered") / F.col("candidates") * 10000 + 0.5) / 10000)
    state = F.when(share < 0.9, "warming").when(F.col("covered") < F.col("candidates"), "partial").otherwise("complete")
    return top_k(both.where("vector is not null"), query, k), counts.select("candidates", "covered", share.alias("coverage"), state.alias("status"))


def sync(nodes: DataFrame, cache: DataFrame, model: str, embed: Callable[[DataFrame], DataFrame], force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new cache rows, report). ``embed`` turns (content_hash, text) into
    (content_hash, vector); only documents that the cache lacks are embedded, each
    once. A vector of another length than the cache's raises."""
    text = document(F.col("kind"), F.col("name"), F.col("qualified_name"), F.col("language"), F.col("properties"))
    docs = nodes.select(content_hash(text).alias("content_hash"), text.alias("text"))
    mine = cache.where((F.col("model") == model) & (F.col("document_version") == DOCUMENT_VERSION))
    todo = docs.dropDuplicates(["content_hash"])
    todo = todo if force else todo.join(mine.select("content_hash"), "content_hash", "left_anti")
    known = mine.agg(F.max("dimensions").alias("d"))
    fresh = embed(todo).join(F.broadcast(known))  # one row
    size = F.size("vector")
    drift = F.raise_error(F.lit("the model's dimension has changed")).cast("int")
    fresh = fresh.select(F.lit(model).alias("model"), F.lit(DOCUMENT_VERSION).alias("document_version"), "content_hash", F.when(F.col("d").isNull() | (F.col("d") == size), size).otherwise(drift).alias("dimensions"), normalized(F.col("vector")).alias("vector"))
    marked = docs.join(todo.select("content_hash", F.lit(True).alias("new")), "content_hash", "left")
    report = marked.agg(F.count("*").alias("candidates"), F.count("new").alias("updated"), (F.count("*") - F.count("new")).alias("unchanged"))
    return fresh, report


def cache_status(cache: DataFrame) -> DataFrame:
    size = F.size("vector") * 4
    return cache.groupBy("model", "dimensions").agg(F.count("*").alias("entries"), F.sum(size).alias("bytes"), F.min("last_used_at").alias("oldest"), F.max("last_used_at").alias("newest"))


def prune(cache: DataFrame, most_bytes: int, ranges: int = 256) -> DataFrame:
    """What stays when the least recently used entries go until the cache fits. The
    running sum is taken over bytes per last use, range by range of last uses, and then
    within the one use that the limit falls in, so no task holds the cache."""
    size = F.size("vector") * 4
    per = stored(cache.groupBy("last_used_at").agg(F.sum(size).alias("b")), "uses")
    row = per.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("t"), F.percentile_approx("last_used_at", [i / ranges for i in range(1, ranges)]).alias("q")).first()
    excess = max(0, row["t"] - most_bytes)
    borders = F.array(*[F.lit(x) for x in sorted(set(row["q"] or []))])
    per = per.withColumn("g", F.size(F.filter(borders, lambda x: x < F.col("last_used_at"))))
    before, sums = 0, []
    for r in per.groupBy("g").agg(F.sum("b").alias("b")).orderBy("g").collect():  # at most ``ranges`` rows
        sums.append((r["g"], before))
        before += r["b"]
    starts = cache.sparkSession.createDataFrame(sums, "g int, start long")
    run = Window.partitionBy("g").orderBy("last_used_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = per.join(starts, "g").withColumn("before", F.col("start") + F.coalesce(F.sum("b").over(run), F.lit(0)))
    rows = cache.join(placed.select("last_used_at", "before", "b"), "last_used_at")
    settled = rows.where(F.col("before") >= excess)
    split = rows.where((F.col("before") < excess) & (F.col("before") + F.col("b") > excess))
    inner = Window.partitionBy("last_used_at").orderBy("model", "document_version", "content_hash").rowsBetween(Window.unboundedPreceding, -1)
    split = split.withColumn("i", F.coalesce(F.sum(size).over(inner), F.lit(0))).where(F.col("before") + F.col("i") >= excess).drop("i")
    return settled.unionByName(split).drop("before", "b")
