"""Catalogs: what is declared, what is only referred to, and who uses it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import under_prefix
from ..plans.scratch import kept_small
from ..vocab import DATA_KINDS, PUBLIC_CONFIG_PROPERTIES
from .traverse import bounded

MOST = 1000


def checked_limit(limit: int | None, default: int = 100, most: int = MOST) -> int:
    if limit is None or limit == 0:
        return default
    if limit < 0:
        raise ValueError("a limit is not negative")
    return min(limit, most)


def checked_repositories(nodes: DataFrame, wanted: list[str]) -> Column:
    """A filter on ``repository``; names that the graph does not know raise."""
    if not wanted:
        return F.lit(True)
    known = {r["repository"] for r in nodes.select("repository").distinct().collect()}  # a federation's members
    if lost := sorted(set(wanted) - known):
        raise ValueError(f"unknown repositories {lost}; known: {sorted(known)}")
    return F.col("repository").isin(*wanted)


def catalog(nodes: DataFrame, kinds: list[str], name: str = "", repositories: list[str] | None = None, prefixes: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Declared and unresolved entries of the kinds, each section with its own limit
    and ``truncated``; ids once, by qualified name, kind, repository and id."""
    hit = nodes.where(F.col("kind").isin(*kinds)).where(checked_repositories(nodes, repositories or []))
    if name:
        hit = hit.where((F.instr(F.lower("name"), name.lower()) > 0) | (F.instr(F.lower("qualified_name"), name.lower()) > 0))
    hit = hit.where(under_prefix(F.col("path"), prefixes or []))
    hit = hit.groupBy("id").agg(F.min_by(F.struct("repository", "kind", "name", "qualified_name", "path", "line", "external"), F.struct("external", "repository")).alias("e")).select("id", "e.*")
    section = F.when(F.col("external"), "unresolved").otherwise("declared")
    return bounded(hit.withColumn("section", section), ["section"], ["qualified_name", "kind", "repository", "id"], checked_limit(limit))


def relation_sites(edges: DataFrame, nodes: DataFrame, subjects: DataFrame, relations: dict[str, str], direction: str, limit: int = MOST) -> DataFrame:
    """The hydrated edges of each subject: subject, relation (as renamed), edge id,
    the counterpart's fields; bounded per subject and edge kind, with ``truncated``.
    ``relations``: edge kind -> relation name."""
    me, other = ("to_id", "from_id") if direction == "in" else ("from_id", "to_id")
    e = edges.where(F.col("kind").isin(*relations)).select(F.col(me).alias("subject"), F.col(other).alias("node_id"), F.col("kind").alias("edge_kind"), F.col("id").alias("edge_id"), "fact_id", F.col("path").alias("site_path"), F.col("line").alias("site_line"))
    e = e.join(subjects.select(F.col("id").alias("subject")).distinct(), "subject", "left_semi")
    e = kept_small(bounded(e, ["subject", "edge_kind"], ["node_id", "fact_id"], limit), "sites")
    near = kept_small(e.select(F.col("node_id").alias("id")).distinct(), "counterparts")
    far = nodes.join(near, "id", "left_semi").groupBy(F.col("id").alias("node_id")).agg(F.min_by(F.struct("repository", "kind", "name", "qualified_name", "external"), F.struct("external", "repository")).alias("n"))
    names = F.element_at(F.create_map(*[F.lit(x) for p in relations.items() for x in p]), F.col("edge_kind"))
    return e.join(far, "node_id").select("subject", names.alias("relation"), "edge_id", "fact_id", "node_id", "n.repository", "n.kind", "n.name", "n.qualified_name", "n.external", "site_path", "site_line", "truncated")


def data_resource_usage(edges: DataFrame, nodes: DataFrame, subjects: DataFrame, limit: int = MOST) -> DataFrame:
    return relation_sites(edges, nodes, subjects, {"reads": "readers", "writes": "writers", "references": "references"}, "in", limit)


def select_resource(nodes: DataFrame, selector: str) -> DataFrame:
    """The table or view that ``selector`` (an id, a qualified name or a name, case
    aside) means: one row, or an error that says whether none or several fit."""
    pool = nodes.where(F.col("kind").isin(*DATA_KINDS))
    if selector.startswith("n:"):
        pool = pool.where(F.col("id") == selector)
    s = selector.lower()
    level = F.when(F.col("id") == selector, 0).when(F.lower("qualified_name") == s, 1).when(F.lower("name") == s, 2)
    ranked = pool.withColumn("_r", F.struct(level.alias("l"), F.col("external"))).where("_r.l is not null")
    found = ranked.groupBy("_r").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).orderBy("_r").limit(1).first()
    if found is None:
        raise LookupError(f"no table or view named {selector!r}")
    if found["n"] > 1:
        raise LookupError(f"{selector!r} is ambiguous: {found['n']} candidates")
    return nodes.where(F.col("id") == found["id"])


def public_properties(properties: Column) -> Column:
    return F.map_filter(properties, lambda k, _: k.isin(*PUBLIC_CONFIG_PROPERTIES))


def withheld_properties(properties: Column) -> Column:
    return F.array_sort(F.map_keys(F.map_filter(properties, lambda k, _: ~k.isin(*PUBLIC_CONFIG_PROPERTIES))))


def config_keys(nodes: DataFrame, name: str = "", limit: int | None = None) -> DataFrame:
    """Configuration keys; property values outside a fixed list are withheld and
    only their names are told."""
    hit = catalog(nodes, ["config_key"], name, limit=limit)
    props = nodes.where("kind = 'config_key'").groupBy("id").agg(F.min_by("properties", "repository").alias("p"))
    return hit.join(props, "id").withColumn("properties", public_properties(F.col("p"))).withColumn("withheld_properties", withheld_properties(F.col("p"))).drop("p")


def config_usage(edges: DataFrame, nodes: DataFrame, subjects: DataFrame, limit: int = MOST) -> DataFrame:
    return relation_sites(edges, nodes, subjects, {"defines": "definitions", "reads_config": "readers", "references": "references"}, "in", limit)


def event_usage(edges: DataFrame, nodes: DataFrame, subjects: DataFrame, limit: int = MOST) -> DataFrame:
    into = relation_sites(edges, nodes, subjects, {"declares": "declarations", "publishes": "producers", "subscribes": "consumers"}, "in", limit)
    return into.unionByName(relation_sites(edges, nodes, subjects, {"handled_by": "handlers"}, "out", limit))


def orphaned_events(edges: DataFrame, nodes: DataFrame, limit: int = MOST) -> DataFrame:
    """Events that lack a producer or a consumer: id, qualified_name, external,
    condition, status. ``unknown`` says that the missing side may exist: a boundary
    event of the same name supplies it, the evidence was truncated, or the event is
    itself only a boundary."""
    events = nodes.where("kind = 'event'").groupBy("id").agg(F.min_by(F.struct("name", "qualified_name", "external"), F.struct("external", "repository")).alias("e")).select("id", "e.*")
    into = relation_sites(edges, nodes, events, {"publishes": "p", "subscribes": "s"}, "in", limit)
    sides = into.unionByName(relation_sites(edges, nodes, events, {"handled_by": "h"}, "out", limit))
    counts = sides.groupBy(F.col("subject").alias("id")).agg(
        F.count_if(F.col("relation") == "p").alias("np"), F.count_if(F.col("relation") != "p").alias("ns"), F.bool_or("truncated").alias("cut")
    )
    rows = events.join(counts, "id", "left").fillna({"np": 0, "ns": 0}).withColumn("cut", F.coalesce("cut", F.lit(False)))
    keys = lambda c: F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias(c)
    local_keys = rows.where("not external").select("id", keys("key")).where("key <> ''")
    far_keys = rows.where("external").select(F.col("id").alias("far"), keys("key")).where("key <> ''")
    # What boundary events of a name say of the local one, but for facts whose
    # (federated) edge already ends there.
    twins = local_keys.join(far_keys, "key").select("id", "far").distinct()
    told = twins.join(into.select(F.col("subject").alias("far"), "relation", "fact_id", F.col("truncated").alias("far_cut")), "far")
    told = told.join(sides.select(F.col("subject").alias("id"), "fact_id"), ["id", "fact_id"], "left_anti")
    told = told.groupBy("id").agg(F.count_if(F.col("relation") == "p").alias("op"), F.count_if(F.col("relation") == "s").alias("os"), F.bool_or("far_cut").alias("far_cut"))
    rows = rows.join(told, "id", "left").fillna({"op": 0, "os": 0}).withColumn("cut", F.col("cut") | F.coalesce("far_cut", F.lit(False)))
    reported = far_keys.join(local_keys.select("key").distinct(), "key", "left_semi").select(F.col("far").alias("id")).distinct()
    rows = rows.where("not external").unionByName(rows.where("external").join(reported, "id", "left_anti"))
    produced, consumed = F.col("np") > 0, F.col("ns") > 0
    condition = F.when(produced & ~consumed, "published_without_consumer").when(consumed & ~produced, "consumed_without_producer").when(~produced & ~consumed, "declared_with_neither")
    supplied = (~produced & (F.col("op") > 0)) | (~consumed & (F.col("os") > 0))
    status = F.when(F.col("external") | supplied | F.col("cut"), "unknown").otherwise("confirmed")
    return rows.withColumn("condition", condition).where("condition is not null").withColumn("status", status).select("id", "qualified_name", "external", "condition", "status")
