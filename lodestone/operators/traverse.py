"""Traversals by iterated joins.

Every traversal takes a table of roots and answers all of them at once: a root id is
part of each key, so N roots cost one loop. A level joins the frontier with the
edges, and what was reached is kept in the session's shared folder, so a lost
executor repeats one level at most. Depth bounds the loop; nothing is collected but
one count a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import stored
from ..vocab import CALLER_RELATIONS

EDGE_ORDER = ("kind", "from_id", "to_id", "id")


def hops(edges: DataFrame, direction: str, relations: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(at, neighbour, kind, from_id, to_id, id): an edge as seen from an end."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    e = edges.where(F.col("kind").isin(*relations)) if relations else edges
    e = e.select(*EDGE_ORDER)
    out = e.select(F.col("from_id").alias("at"), F.col("to_id").alias("neighbour"), *EDGE_ORDER)
    back = e.select(F.col("to_id").alias("at"), F.col("from_id").alias("neighbour"), *EDGE_ORDER)
    if direction == "out":
        return out
    # A loop is one edge of its node, not two.
    return back if direction == "in" else out.unionByName(back.where("at <> neighbour"))


def neighborhood(edges: DataFrame, roots: DataFrame, direction: str = "both", relations: list[str] | tuple[str, ...] = (), depth: int = 1, limit: int = 1000, seeds: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Breadth-first from each row of ``roots`` (root). Returns

    - nodes (root, id, depth),
    - edges (root, id, depth, direct): every edge seen from an expanded node, even
      where the node limit dropped its far end,
    - flags (root, truncated).

    Within a level, frontier nodes come by id and their edges by kind, from, to and
    id; that order decides which new nodes are admitted when ``limit`` is reached.
    ``seeds`` (root, id, edge_id, seq) enter at depth 1 before the level's own.
    """
    limit = 1000 if limit <= 0 else limit
    step = hops(edges, direction, relations)
    roots = roots.select("root").distinct()
    visited = roots.select("root", F.col("root").alias("id"), F.lit(0).alias("depth"))
    frontier = visited
    seen_edges: list[DataFrame] = []
    cut: list[DataFrame] = []
    waiting = None
    if seeds is not None:
        s = seeds.where("id <> root").dropDuplicates(["root", "id"])
        s = s.withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("seq")))
        cut.append(s.where(F.col("n") > limit - 1).select("root").distinct())
        s = s.where(F.col("n") <= limit - 1)
        waiting = stored(s.select("root", "id", F.lit(1).alias("depth"), "edge_id"), "seeds")
        visited = stored(visited.unionByName(waiting.drop("edge_id")), "visited")
        seen_edges.append(waiting.select("root", F.col("edge_id").alias("id"), F.lit(1).alias("level")))
    for level in range(1, max(depth, 1) + 1):
        found = frontier.select("root", F.col("id").alias("at")).join(step, "at")
        found = stored(found, "found")
        seen_edges.append(found.select("root", "id").distinct().withColumn("level", F.lit(level)))
        # A node's first occurrence decides its place; then the places are numbered.
        place = F.struct("at", *EDGE_ORDER)
        fresh = found.groupBy("root", F.col("neighbour").alias("id")).agg(F.min(place).alias("p"))
        fresh = fresh.join(visited.select("root", "id"), ["root", "id"], "left_anti")
        room = visited.groupBy("root").agg((F.lit(limit) - F.count("*")).alias("room"))
        # One place past the limit shows the cut; Spark drops the rest before the shuffle.
        fresh = fresh.withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("p"))).where(F.col("n") <= limit + 1).join(room, "root")
        fresh = stored(fresh.select("root", "id", F.lit(level).alias("depth"), (F.col("n") <= F.col("room")).alias("fits")), "fresh")
        cut.append(fresh.where("not fits").select("root").distinct())
        frontier = fresh.where("fits").drop("fits")
        visited = visited.unionByName(frontier)
        if level == 1 and waiting is not None:
            frontier = frontier.unionByName(waiting.drop("edge_id"))
        if level < depth and frontier.isEmpty():
            break
    first = seen_edges[0]
    for s in seen_edges[1:]:
        first = first.unionByName(s)
    first = first.groupBy("root", "id").agg(F.min("level").alias("level"))
    ends = first.join(edges.select("id", "from_id", "to_id"), "id")
    d = visited.withColumnRenamed("depth", "d")
    for end in ("from_id", "to_id"):
        ends = ends.join(d.select("root", F.col("id").alias(end), F.col("d").alias(f"{end}_d")), ["root", end], "left")
    # An end first reached in the level the edge was found at, or later, counts as that level.
    near = lambda c: F.least(F.coalesce(F.col(c), F.col("level")), F.col("level"))
    labelled = ends.select(
        "root", "id", F.greatest(near("from_id_d"), near("to_id_d")).alias("depth"),
        ((F.col("from_id") == F.col("root")) | (F.col("to_id") == F.col("root"))).alias("direct"),
    )
    truncated = cut[0]
    for c in cut[1:]:
        truncated = truncated.unionByName(c)
    flags = roots.join(truncated.distinct().withColumn("truncated", F.lit(True)), "root", "left").select("root", F.coalesce("truncated", F.lit(False)).alias("truncated"))
    return visited, labelled, flags


def callers(edges: DataFrame, roots: DataFrame, depth: int = 3, limit: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    return neighborhood(edges, roots, "in", CALLER_RELATIONS, depth, limit)


def callees(edges: DataFrame, roots: DataFrame, depth: int = 3, limit: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    return neighborhood(edges, roots, "out", CALLER_RELATIONS, depth, limit)


def shortest_paths(edges: DataFrame, pairs: DataFrame, direction: str = "out", relations: list[str] | tuple[str, ...] = (), most_visited: int = 10_000) -> DataFrame:
    """``pairs``: (pair, src, dst). One row per step of each pair's path: pair, step,
    id, edge_id (null at step 0); no rows for pairs without a path.

    A queue-ordered search: a node's parent is the earliest discovered one, ties
    between its edges go by kind, from, to and id; ``seq`` is the discovery number. It
    ends where nothing is left to visit or ``most_visited`` nodes were, whatever the
    depth."""
    step = hops(edges, direction, relations)
    reached = stored(pairs.select("pair", F.col("src").alias("id"), F.lit(0).alias("level"), F.lit(1).cast("long").alias("seq"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("edge_id")), "reached")
    goals = pairs.select("pair", F.col("dst").alias("goal"))
    frontier, level = reached, 0
    while True:
        level += 1
        done = reached.join(goals, (reached["pair"] == goals["pair"]) & (reached["id"] == goals["goal"]), "left_semi").select("pair").distinct()
        top = reached.groupBy("pair").agg(F.max("seq").alias("top"))
        live = frontier.join(done, "pair", "left_anti")
        found = live.select("pair", F.col("id").alias("at"), "seq").join(step, "at")
        order = F.struct("seq", *EDGE_ORDER)
        fresh = found.groupBy("pair", F.col("neighbour").alias("id")).agg(F.min(F.struct(order.alias("o"), F.col("at").alias("parent"), F.col("id").alias("edge_id"))).alias("b"))
        fresh = fresh.join(reached.select("pair", "id"), ["pair", "id"], "left_anti").join(top, "pair")
        number = F.row_number().over(Window.partitionBy("pair").orderBy("b.o"))
        fresh = fresh.withColumn("n", number).where(F.col("n") <= most_visited).where(F.col("top") + F.col("n") <= most_visited)
        frontier = stored(fresh.select("pair", "id", F.lit(level).alias("level"), (F.col("top") + F.col("n")).alias("seq"), F.col("b.parent").alias("parent"), F.col("b.edge_id").alias("edge_id")), "frontier")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
        if level % 16 == 0:  # a deep search keeps a short plan
            reached = stored(reached, "reached")
    ends = reached.join(goals, (reached["pair"] == goals["pair"]) & (reached["id"] == goals["goal"]), "left_semi")
    walk, path, steps = ends, ends, 0
    while True:
        back = walk.where("parent is not null").select("pair", F.col("parent").alias("id"))
        if back.isEmpty():
            break
        walk = stored(reached.join(back, ["pair", "id"], "left_semi"), "walk")
        path, steps = path.unionByName(walk), steps + 1
        if steps % 16 == 0:
            path = stored(path, "path")
    return path.select("pair", F.col("level").alias("step"), "id", "edge_id")


def declared_members(edges: DataFrame, nodes: DataFrame, roots: DataFrame, limit: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Local methods and functions that a local class, type or interface declares:
    (root, id, edge_id, seq) in edge order, cut at ``limit``, and (root, truncated)."""
    holders = nodes.where("not external").where(F.col("kind").isin("class", "type", "interface")).select(F.col("id").alias("root"))
    parts = nodes.where("not external").where(F.col("kind").isin("method", "function")).select(F.col("id").alias("to_id"))
    own = roots.join(holders, "root", "left_semi")
    found = own.join(edges.where("kind = 'declares'").withColumnRenamed("from_id", "root"), "root").join(parts, "to_id", "left_semi")
    first = found.groupBy("root", "to_id").agg(F.min("id").alias("edge_id"))
    numbered = first.withColumn("seq", F.row_number().over(Window.partitionBy("root").orderBy("to_id", "edge_id")))
    flags = numbered.groupBy("root").agg((F.max("seq") > limit).alias("truncated"))
    return numbered.where(F.col("seq") <= limit).select("root", F.col("to_id").alias("id"), "edge_id", "seq"), flags


def bounded(rows: DataFrame, group: list[str | Column], order: list[str | Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group and ``truncated``: whether there were
    more. Spark keeps at most ``limit + 1`` a group before it shuffles."""
    w = Window.partitionBy(*group).orderBy(*order)
    kept = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit + 1)
    more = F.max(F.col("_n")).over(Window.partitionBy(*group)) > limit
    return kept.withColumn("truncated", more).where(F.col("_n") <= limit).drop("_n")
