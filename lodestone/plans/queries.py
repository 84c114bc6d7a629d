"""Registered queries of the graph operators over the fixture graph, each with the
SQL that states the same rows. Limits appear only where the bound is the feature."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import http, ids, text
from ..operators import catalog, federation, incremental, match, reports, search, semantic, topology, traverse
from ..operators.resolve import prop, resolve
from ..sources.extract import extract
from ..vocab import CALLER_RELATIONS, CANDIDATE_KINDS, FAILURE_SECTIONS, IMPACT_RELATIONS, PEER_TARGET_KINDS
from .fixture import DUCK, Graph, Sql, _grouped, graph
from .scratch import passing, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_SQL = Sql(DUCK)
_WITH = _SQL.resolved()


def registered(name: str, oracle: str | None, raw: bool = False) -> Callable:
    """Register a function of the graph (or, with ``raw``, of session and folder).
    ``oracle`` is SQL after the graph's CTEs; a leading ``, name AS`` adds CTEs."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f if raw else (lambda spark, sf_dir: f(graph(spark, sf_dir)))
        if oracle is not None:
            ORACLES[name] = oracle if raw else _WITH + oracle
        return f

    return add


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- resolution -----------------------------------------------------------------


@registered("r1_r5_edges", "SELECT repository, id, fact_id, from_id, to_id, kind, path, CAST(line AS BIGINT) AS line FROM edges")
def edges_query(g: Graph) -> DataFrame:
    return g.edges.select("repository", "id", "fact_id", "from_id", "to_id", "kind", "path", F.col("line").cast("long").alias("line"))


@registered("r4_external_nodes", "SELECT repository, id, kind, name, qualified_name FROM externals")
def externals_query(g: Graph) -> DataFrame:
    return g.externals.select("repository", "id", "kind", "name", "qualified_name")


@registered("r6_request_targets", "SELECT fact_id, to_id, resolution FROM edges WHERE kind = 'requests'")
def requests_query(g: Graph) -> DataFrame:
    return g.edges_of("requests").where("kind = 'requests'").select("fact_id", "to_id", prop(F.col("properties"), "http_destination_resolution").alias("resolution"))


@registered(
    "r7_derived_tests",
    "SELECT t.id, t.from_id, t.to_id, 'structural' AS coverage, e.kind AS evidence_relation, e.id AS evidence_edge_id FROM tests t JOIN plain_edges e ON e.fact_id = t.fact_id AND e.to_id = t.to_id",
)
def tests_query(g: Graph) -> DataFrame:
    p = F.col("properties")
    return g.edges_of("tests").where("kind = 'tests'").select("id", "from_id", "to_id", *[prop(p, k).alias(k) for k in ("coverage", "evidence_relation", "evidence_edge_id")])


# ---- counts -----------------------------------------------------------------------


@registered(
    "a1_counts",
    "SELECT 'nodes' AS what, count(*) AS n FROM all_nodes UNION ALL SELECT 'facts', count(*) FROM facts UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'external', count(*) FROM externals",
)
def counts_query(g: Graph) -> DataFrame:
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(n).alias("what"), "n") for n, t in (("nodes", g.nodes), ("facts", g.facts), ("edges", g.edges), ("external", g.externals))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@registered("a2_node_kinds", "SELECT kind, count(*) AS n FROM all_nodes GROUP BY kind")
def node_kinds(g: Graph) -> DataFrame:
    return g.nodes.groupBy("kind").agg(F.count("*").alias("n"))


@registered("a2_edge_kinds", "SELECT kind, count(*) AS n FROM edges GROUP BY kind")
def edge_kinds(g: Graph) -> DataFrame:
    return g.edges.groupBy("kind").agg(F.count("*").alias("n"))


@registered("a5_federated_counts", "SELECT 'nodes' AS what, count(*) AS n FROM all_nodes UNION ALL SELECT 'facts', count(*) FROM facts UNION ALL SELECT 'edges', count(*) FROM edges")
def federated_counts(g: Graph) -> DataFrame:
    """An edge a fact, and the derived ones: to count them, only those are resolved."""
    count = lambda rows: rows.groupBy("repository").agg(F.count("*").alias("n"))
    facts = g.fact_counts()
    return federation.summed_counts(count(g.nodes), facts, facts.unionByName(count(g.tests())))


# ---- find and match ---------------------------------------------------------------


@registered("p2_find", "SELECT id, kind, name, qualified_name FROM all_nodes WHERE lower(name) LIKE '%red_w%' OR lower(qualified_name) LIKE '%red_w%' ORDER BY external, length(qualified_name), qualified_name, id LIMIT 20")
def find_query(g: Graph) -> DataFrame:
    return match.find(g.nodes_holding("Red_W"), "Red_W").select("id", "kind", "name", "qualified_name")


@registered(
    "g1_federated_find",
    """, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY external, repository) AS rn FROM all_nodes WHERE lower(name) LIKE '%blue%' OR lower(qualified_name) LIKE '%blue%') WHERE rn = 1)
SELECT id, qualified_name, external FROM one ORDER BY CASE WHEN lower(qualified_name) = 'blue' THEN 0 WHEN lower(name) = 'blue' THEN 1 WHEN starts_with(lower(name), 'blue') THEN 2 WHEN starts_with(lower(qualified_name), 'blue') THEN 3 ELSE 4 END, qualified_name, id LIMIT 20""",
)
def federated_find(g: Graph) -> DataFrame:
    return match.find(g.nodes_holding("blue"), "blue", federated=True).select("id", "qualified_name", "external")


@registered(
    "p3_list_by_kind",
    "SELECT id, kind, qualified_name FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY qualified_name, id) AS rn FROM all_nodes WHERE kind IN ('table', 'view', 'type') AND NOT external AND (instr(lower(name), 'e') > 0 OR instr(lower(qualified_name), 'e') > 0) AND (path = 'catalog' OR starts_with(path, 'catalog/'))) WHERE rn <= 100",
)
def list_by_kind(g: Graph) -> DataFrame:
    return match.list_by_kind(g.local, ["table", "view", "type"], False, "E", ["catalog"], 100).select("id", "kind", "qualified_name")


@registered("p4_messages", "SELECT id, qualified_name FROM nodes WHERE kind = 'type' AND declaration = 'message' AND starts_with(qualified_name, 'Brand#1.')")
def messages_query(g: Graph) -> DataFrame:
    return match.canonical_messages(g.local, "Brand#1").select("id", "qualified_name")


SELECTORS = ("OP12", "op12", "EUROPE", "red widget", "Small Ring", "machinery", "Customer#000000001", "blue", "view", "no such name")
_EVIDENCE = f""", sel AS (SELECT unnest([{quoted(SELECTORS)}]) AS selector),
found AS (SELECT selector, n.*, 0 AS level, qualified_name = selector AS strict FROM sel JOIN all_nodes n ON lower(qualified_name) = lower(selector)
  UNION ALL SELECT selector, n.*, 1, name = selector FROM sel JOIN all_nodes n ON lower(name) = lower(selector)
  UNION ALL SELECT selector, n.*, 2, instr(qualified_name, selector) > 0 FROM sel JOIN all_nodes n ON instr(lower(qualified_name), lower(selector)) > 0),
grp AS (SELECT selector, level, external, count(*) AS total, count(*) FILTER (strict) AS strict FROM found GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY selector ORDER BY strict = 0, level, external) AS rn FROM grp) WHERE rn = 1)
"""


def _selectors(g: Graph) -> DataFrame:
    return g.nodes.sparkSession.createDataFrame([(s,) for s in SELECTORS], "selector string")


@registered("p5_match_groups", _EVIDENCE + "SELECT selector, level, external, strict, total FROM best")
def match_groups(g: Graph) -> DataFrame:
    return match.match(g.nodes, _selectors(g))[0].select("selector", "level", "external", "strict", "total")


@registered(
    "p6_match_members",
    _EVIDENCE + "SELECT selector, id, strict, CAST(n AS INT) AS n FROM (SELECT f.selector, f.id, f.strict, row_number() OVER (PARTITION BY f.selector ORDER BY f.strict DESC, length(f.qualified_name), f.qualified_name, f.id) AS n FROM found f JOIN best b ON f.selector = b.selector AND f.level = b.level AND f.external = b.external) WHERE n <= 25",
)
def match_members(g: Graph) -> DataFrame:
    return match.match(g.nodes, _selectors(g))[1].select("selector", "id", "strict", "n")


@registered(
    "g2_resolve_selectors",
    _EVIDENCE
    + """, pool AS (SELECT f.selector, count(*) AS n, min(f.id) AS id FROM found f JOIN best b ON f.selector = b.selector AND f.level = b.level AND f.external = b.external WHERE f.strict OR b.strict = 0 GROUP BY f.selector)
SELECT s.selector, CASE WHEN p.n IS NULL THEN 'missing' WHEN p.n = 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN p.n = 1 THEN p.id END AS id FROM sel s LEFT JOIN pool p ON s.selector = p.selector""",
)
def resolve_query(g: Graph) -> DataFrame:
    return match.resolve_selectors(g.nodes, _selectors(g)).select("selector", "status", "id")


@registered("p11_candidates", f"SELECT id, kind, qualified_name FROM nodes WHERE kind IN ({quoted(CANDIDATE_KINDS)})")
def candidates_query(g: Graph) -> DataFrame:
    return match.candidate_nodes(g.local).select("id", "kind", "qualified_name")


@registered(
    "p12_external_matches",
    "SELECT DISTINCT x.id, n.id AS declaration FROM externals x JOIN nodes n ON n.kind IN ('table', 'view') AND (x.name IN (n.name, n.qualified_name) OR x.qualified_name IN (n.name, n.qualified_name))",
)
def external_matches(g: Graph) -> DataFrame:
    return federation.external_matches(g.nodes, g.local.where("kind in ('table', 'view')"))


# ---- traversals -------------------------------------------------------------------


def _walk(kinds: str, relations: tuple[str, ...], direction: str, depth: int) -> str:
    me, far = ("to_id", "from_id") if direction == "in" else ("from_id", "to_id")
    return f""", walk AS (SELECT id AS root, id, 0 AS depth FROM nodes WHERE kind IN ({kinds})
  UNION SELECT w.root, e.{far}, w.depth + 1 FROM walk w JOIN edges e ON e.{me} = w.id AND e.kind IN ({quoted(relations)}) WHERE w.depth < {depth}),
reached AS (SELECT root, id, min(depth) AS depth FROM walk GROUP BY root, id)
"""


def _roots(g: Graph, *kinds: str) -> DataFrame:
    return g.local.where(F.col("kind").isin(*kinds)).select(F.col("id").alias("root"))


@registered("g5_callers", _walk("'method'", ("calls", "handled_by"), "in", 3) + "SELECT root, id, depth FROM reached")
def callers_query(g: Graph) -> DataFrame:
    return traverse.callers(g.edges_of(*CALLER_RELATIONS), _roots(g, "method"), limit=1_000_000)[0]


@registered("g5_callees", _walk("'test'", ("calls", "handled_by"), "out", 3) + "SELECT root, id, depth FROM reached")
def callees_query(g: Graph) -> DataFrame:
    return traverse.callees(g.edges_of(*CALLER_RELATIONS), _roots(g, "test"), limit=1_000_000)[0]


@registered(
    "g4_neighbor_edges",
    _walk("'table'", ("reads", "writes", "references", "tests"), "in", 2)
    + """, seen AS (SELECT r.root, e.id, e.from_id, e.to_id, min(r.depth) + 1 AS level FROM reached r JOIN edges e ON e.to_id = r.id AND e.kind IN ('reads', 'writes', 'references', 'tests') WHERE r.depth < 2 GROUP BY ALL)
SELECT s.root, s.id, greatest(least(coalesce(f.depth, level), level), least(coalesce(t.depth, level), level)) AS depth, s.from_id = s.root OR s.to_id = s.root AS direct
FROM seen s LEFT JOIN reached f ON f.root = s.root AND f.id = s.from_id LEFT JOIN reached t ON t.root = s.root AND t.id = s.to_id""",
)
def neighbor_edges(g: Graph) -> DataFrame:
    return traverse.neighborhood(g.edges_of("reads", "writes", "references", "tests"), _roots(g, "table"), "in", ("reads", "writes", "references", "tests"), 2, 100_000)[1]


@registered("g6_path_lengths", _walk("'test'", ("calls",), "out", 6) + ", dst AS (SELECT root, max(id) AS dst FROM reached GROUP BY root) SELECT d.root AS pair, CAST(r.depth AS INT) AS length FROM dst d JOIN reached r ON r.root = d.root AND r.id = d.dst")
def path_lengths(g: Graph) -> DataFrame:
    """From each test to the largest id that it reaches in six calls."""
    edges = g.edges_of("calls")
    reached = traverse.neighborhood(edges, _roots(g, "test"), "out", ("calls",), 6, 100_000)[0]
    pairs = reached.groupBy("root").agg(F.max("id").alias("dst")).select(F.col("root").alias("pair"), F.col("root").alias("src"), "dst")
    return traverse.shortest_paths(edges, pairs, "out", ("calls",)).groupBy("pair").agg(F.max("step").alias("length"))


def _up(depth: int) -> str:
    return _walk("'table', 'view'", IMPACT_RELATIONS, "in", depth)


@registered("g7_impact", _up(4) + "SELECT root, id, depth FROM reached")
def impact_query(g: Graph) -> DataFrame:
    return traverse.neighborhood(g.edges_of(*IMPACT_RELATIONS), _roots(g, "table", "view"), "in", IMPACT_RELATIONS, 4, 1_000_000)[0]


@registered(
    "a6_impacted_files",
    _up(2)
    + f""", crossed AS (SELECT DISTINCT r.root, e.id, e.repository, e.path FROM reached r JOIN edges e ON e.to_id = r.id AND e.kind IN ({quoted(IMPACT_RELATIONS)}) WHERE r.depth < 2),
rows_ AS (SELECT r.root, n.repository, n.path, r.id AS node_id, CAST(NULL AS VARCHAR) AS edge_id FROM reached r JOIN nodes n ON n.id = r.id WHERE r.id <> r.root AND n.path <> ''
  UNION ALL SELECT root, repository, path, CAST(NULL AS VARCHAR), id FROM crossed WHERE path <> '')
SELECT root, repository, path, count(DISTINCT node_id) AS n_nodes, count(DISTINCT edge_id) AS n_edges FROM rows_ GROUP BY ALL""",
)
def impacted_files(g: Graph) -> DataFrame:
    n, e, _ = traverse.neighborhood(g.edges_of(*IMPACT_RELATIONS), _roots(g, "table", "view"), "in", IMPACT_RELATIONS, 2, 1_000_000)
    up = F.lit("upstream").alias("direction")
    files = reports.impacted_files(g.edges_of(*IMPACT_RELATIONS), g.local, n.select("*", up), e.select("*", up))
    return files.select("root", "repository", "path", F.size("node_ids").cast("long").alias("n_nodes"), F.size("edge_ids").cast("long").alias("n_edges"))


@registered(
    "g10_buckets",
    _walk("'function'", IMPACT_RELATIONS, "out", 1)
    + f""", crossed AS (SELECT DISTINCT r.root, e.id, e.kind, e.from_id, e.to_id FROM reached r JOIN edges e ON e.from_id = r.id AND e.kind IN ({quoted(IMPACT_RELATIONS)}) WHERE r.depth < 1),
k AS (SELECT id, min_by(kind, external) AS kind FROM all_nodes GROUP BY id)
SELECT c.root, CASE WHEN k.kind = 'config_key' THEN 'config' WHEN k.kind = 'event' THEN 'event' ELSE 'data' END AS bucket, c.id, c.to_id AS subject FROM crossed c JOIN k ON k.id = c.to_id
WHERE (k.kind = 'config_key' AND c.kind IN ('reads_config', 'defines', 'references')) OR (k.kind IN ('table', 'view', 'column') AND c.kind IN ('reads', 'writes', 'references')) OR (k.kind = 'event' AND c.kind IN ('publishes', 'subscribes'))""",
)
def buckets_query(g: Graph) -> DataFrame:
    e = traverse.neighborhood(g.edges_of(*IMPACT_RELATIONS), _roots(g, "function"), "out", IMPACT_RELATIONS, 1, 100_000)[1]
    return reports.relation_buckets(g.edges_of(*IMPACT_RELATIONS), g.nodes, e)


_CASE = " ".join(f"WHEN '{k}' THEN '{s}'" for k, s in FAILURE_SECTIONS.items())


@registered(
    "g12_failure_flow",
    f""", flat AS (SELECT id, min_by(qualified_name, external) AS qualified_name, min(external) AS external FROM all_nodes GROUP BY id),
f AS (SELECT e.from_id AS root, CASE e.kind {_CASE} END AS section, 'outgoing' AS direction, e.kind, e.id, e.to_id AS node_id, t.qualified_name, t.external AS unresolved
  FROM edges e JOIN nodes n ON n.id = e.from_id AND n.kind IN ('function', 'method', 'test') JOIN flat t ON t.id = e.to_id WHERE e.kind IN ({quoted(FAILURE_SECTIONS)})),
ranked AS (SELECT *, row_number() OVER (PARTITION BY root, section ORDER BY direction, kind, qualified_name, id) AS rn, count(*) OVER (PARTITION BY root, section) AS c FROM f)
SELECT root, section, direction, kind, id, node_id, unresolved, c > 2 AS truncated FROM ranked WHERE rn <= 2""",
)
def failure_query(g: Graph) -> DataFrame:
    rows = reports.failure_flow(g.edges_of(*FAILURE_SECTIONS), g.nodes_of("type").where("kind = 'type'"), _roots(g, "function", "method", "test"), "out", 2)
    return rows.select("root", "section", "direction", "kind", "id", "node_id", "unresolved", "truncated")


@registered(
    "g13_test_coverage",
    """, roles AS (SELECT id, CASE WHEN kind = 'test' THEN 'test' WHEN test_role IN ('helper', 'lifecycle', 'scope') THEN 'helper' ELSE 'code' END AS role FROM nodes),
step AS (SELECT DISTINCT e.from_id AS a, e.to_id AS b, r.role FROM edges e JOIN roles r ON r.id = e.to_id WHERE e.kind IN ('tests', 'calls', 'references')),
walk AS (SELECT id AS root, id AS here, [id] AS path, 0 AS depth, 'helper' AS role FROM roles WHERE role = 'test'
  UNION ALL SELECT w.root, s.b, list_append(w.path, s.b), w.depth + 1, s.role FROM walk w JOIN step s ON s.a = w.here WHERE w.role = 'helper' AND NOT list_contains(w.path, s.b) AND w.depth < 8)
SELECT root, here AS id, CAST(min(depth) AS INT) AS depth FROM walk WHERE role = 'code' GROUP BY root, here""",
)
def coverage_query(g: Graph) -> DataFrame:
    return reports.test_coverage(g.edges_of(*reports.TEST_RELATIONS), g.local, _roots(g, "test"), limit=1000)[0].select("root", "id", "depth")


# ---- catalogs ---------------------------------------------------------------------


def _catalog(kinds: str, limit: int) -> str:
    return f""", one AS (SELECT id, arg_min(kind, external) AS kind, arg_min(qualified_name, external) AS qualified_name, min(repository) AS repository, min(external) AS external FROM all_nodes WHERE kind IN ({kinds}) GROUP BY id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY external ORDER BY qualified_name, kind, repository, id) AS rn, count(*) OVER (PARTITION BY external) AS c FROM one)
SELECT id, kind, qualified_name, CASE WHEN external THEN 'unresolved' ELSE 'declared' END AS section, c > {limit} AS truncated FROM ranked WHERE rn <= {limit}"""


@registered("c1_data_resources", _catalog("'table', 'view'", 100))
def resources_query(g: Graph) -> DataFrame:
    return catalog.catalog(g.nodes_of("table", "view"), ["table", "view"]).select("id", "kind", "qualified_name", "section", "truncated")


def _sites(kinds: str, names: dict[str, str], limit: int) -> str:
    case = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())
    return f""", s AS (SELECT DISTINCT id FROM all_nodes WHERE kind IN ({kinds})),
ranked AS (SELECT e.*, row_number() OVER (PARTITION BY e.to_id, e.kind ORDER BY e.from_id, e.fact_id) AS rn, count(*) OVER (PARTITION BY e.to_id, e.kind) AS c FROM edges e JOIN s ON s.id = e.to_id WHERE e.kind IN ({quoted(names)}))
SELECT to_id AS subject, CASE kind {case} END AS relation, id AS edge_id, from_id AS node_id, c > {limit} AS truncated FROM ranked WHERE rn <= {limit}"""


_SITE_COLUMNS = ("subject", "relation", "edge_id", "node_id", "truncated")
_USES = {"reads": "readers", "writes": "writers", "references": "references"}


@registered("c2_data_usage", _sites("'table', 'view'", _USES, 3))
def usage_query(g: Graph) -> DataFrame:
    return catalog.data_resource_usage(g.edges_of("reads", "writes", "references"), g.local, g.nodes_of("table", "view").where("kind in ('table', 'view')"), 3).select(*_SITE_COLUMNS)


@registered("c3_config_usage", _sites("'config_key'", {"defines": "definitions", "reads_config": "readers", "references": "references"}, 1000))
def config_query(g: Graph) -> DataFrame:
    return catalog.config_usage(g.edges_of("defines", "reads_config", "references"), g.local, g.nodes_of("config_key").where("kind = 'config_key'")).select(*_SITE_COLUMNS)


@registered("c4_event_usage", _sites("'event'", {"declares": "declarations", "publishes": "producers", "subscribes": "consumers"}, 1000))
def events_query(g: Graph) -> DataFrame:
    return catalog.event_usage(g.edges_of("declares", "publishes", "subscribes", "handled_by"), g.nodes, g.nodes_of("event").where("kind = 'event'")).select(*_SITE_COLUMNS)


@registered(
    "c5_orphaned_events",
    """, ev AS (SELECT id, arg_min(name, external) AS name, arg_min(qualified_name, external) AS q, min(external) AS x FROM all_nodes WHERE kind = 'event' GROUP BY id),
c AS (SELECT ev.*, count(*) FILTER (e.kind = 'publishes') AS p, count(*) FILTER (e.kind = 'subscribes') AS s FROM ev LEFT JOIN edges e ON e.to_id = ev.id GROUP BY ALL),
o AS (SELECT l.id, sum(f.p) AS op, sum(f.s) AS os, max(greatest(f.p, f.s)) > 1000 AS cut FROM c l JOIN c f ON NOT l.x AND f.x AND (f.name IN (l.name, l.q) OR f.q IN (l.name, l.q)) GROUP BY l.id),
r AS (SELECT c.*, coalesce(o.op, 0) AS op, coalesce(o.os, 0) AS os, coalesce(o.cut, false) OR greatest(p, s) > 1000 AS cut FROM c LEFT JOIN o ON o.id = c.id WHERE NOT c.x OR NOT EXISTS (SELECT 1 FROM c l WHERE NOT l.x AND (c.name IN (l.name, l.q) OR c.q IN (l.name, l.q))))
SELECT id, q AS qualified_name, x AS external, CASE WHEN p > 0 THEN 'published_without_consumer' WHEN s > 0 THEN 'consumed_without_producer' ELSE 'declared_with_neither' END AS condition,
CASE WHEN x OR cut OR (p = 0 AND op > 0) OR (s = 0 AND os > 0) THEN 'unknown' ELSE 'confirmed' END AS status FROM r WHERE p = 0 OR s = 0""",
)
def orphans_query(g: Graph) -> DataFrame:
    return catalog.orphaned_events(g.edges_of("publishes", "subscribes", "handled_by"), g.nodes_of("event", relations=("publishes", "subscribes")))


# ---- topology ---------------------------------------------------------------------

_OWN = ", own AS (SELECT n.id, min(e.from_id) AS component FROM nodes n JOIN nodes f ON f.kind = 'file' AND f.repository = n.repository AND f.path = n.owner_file JOIN edges e ON e.to_id = f.id AND e.kind = 'contains' JOIN nodes c ON c.id = e.from_id AND c.kind = 'component' GROUP BY n.id),\nsvc AS (SELECT n.id, coalesce(own.component, 'repository:' || min(n.repository)) AS service FROM nodes n LEFT JOIN own ON own.id = n.id GROUP BY n.id, own.component)\n"


@registered("to1_ownership", _OWN + "SELECT id, component FROM own")
def ownership_query(g: Graph) -> DataFrame:
    return topology.ownership(g.edges_of("contains"), g.local)


@registered("to2_endpoints", "SELECT id, repository, split_part(name, ' ', 1) AS method, substr(name, instr(name, ' ') + 1) AS route FROM nodes WHERE kind = 'endpoint'")
def endpoints_query(g: Graph) -> DataFrame:
    return topology.endpoints(g.local).select("id", "repository", "method", "route")


@registered(
    "to2_route_filter",
    "SELECT id, split_part(name, ' ', 1) AS method FROM nodes WHERE kind = 'endpoint' AND substr(name, instr(name, ' ') + 1) IN ('/en/825', '/en/{id}', '/{lang}/825', '/en/{rest...}')",
)
def route_filter_query(g: Graph) -> DataFrame:
    return topology.endpoints(g.local, route="/en/825").select("id", "method")


_SITE_NAMES = {"handled_by": "handlers", "uses_middleware": "middleware"}


@registered(
    "to2_endpoint_sites",
    f"""SELECT e.from_id AS subject, CASE e.kind {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SITE_NAMES.items())} END AS relation, e.id AS edge_id, e.to_id AS node_id, x.external
FROM edges e JOIN (SELECT id, min(external) AS external FROM all_nodes GROUP BY id) x ON x.id = e.to_id JOIN nodes n ON n.id = e.from_id AND n.kind = 'endpoint' WHERE e.kind IN ({quoted(_SITE_NAMES)})""",
)
def endpoint_sites_query(g: Graph) -> DataFrame:
    return topology.endpoint_sites(g.edges_of("exposes", "handled_by", "uses_middleware"), g.nodes_of(relations=("exposes", "handled_by", "uses_middleware")), g.local.where("kind = 'endpoint'")).select("subject", "relation", "edge_id", "node_id", "external")


@registered(
    "to3_handlers",
    """, x AS (SELECT id, min(external) AS external FROM all_nodes GROUP BY id), h AS (SELECT e.from_id, count(DISTINCT e.to_id) AS n, bool_or(x.external) AS x FROM edges e JOIN x ON x.id = e.to_id WHERE e.kind = 'handled_by' GROUP BY e.from_id)
SELECT n.id AS subject, CASE WHEN h.n IS NULL THEN 'missing' WHEN h.n > 1 THEN 'ambiguous' WHEN h.x THEN 'unresolved' ELSE 'resolved' END AS status, coalesce(h.n, 0) AS n_handlers FROM nodes n LEFT JOIN h ON h.from_id = n.id WHERE n.kind = 'endpoint'""",
)
def handlers_query(g: Graph) -> DataFrame:
    found = topology.handlers(g.edges_of("handled_by"), g.nodes_of(relations=("handled_by",)), g.local.where("kind = 'endpoint'"))
    return found.select("subject", "status", F.size("handlers").cast("long").alias("n_handlers"))


@registered(
    "j3_external_requests",
    "SELECT e.id, e.fact_id, e.from_id, e.to_id, x.qualified_name AS target FROM edges e JOIN externals x ON x.id = e.to_id AND x.repository = e.repository WHERE e.kind = 'requests'",
)
def external_requests_query(g: Graph) -> DataFrame:
    return topology.external_requests(g.edges_of("requests"), g.nodes_of("endpoint")).select("id", "fact_id", "from_id", "to_id", "target")


@registered(
    "to4_outbound_requests",
    """, asked AS (SELECT e.fact_id AS request, e.from_id AS source_id, e.repository, e.id AS edge_id, e.to_id, coalesce(n.name, f.target) AS target, f.http_authority, e.resolution FROM edges e JOIN facts f ON f.id = e.fact_id LEFT JOIN nodes n ON n.id = e.to_id WHERE e.kind = 'requests')
SELECT request, source_id, repository, split_part(target, ' ', 1) AS method, substr(target, instr(target, ' ') + 1) AS route, edge_id, resolution, CASE WHEN http_authority <> '' THEN 'external' ELSE 'local' END AS authority, to_id AS target_id FROM asked""",
)
def outbound_query(g: Graph) -> DataFrame:
    return topology.outbound_requests(g.edges_of("requests"), g.nodes_of("endpoint")).select("request", "source_id", "repository", "method", "route", "edge_id", "resolution", "authority", "target_id")


_LINKS = _OWN + """, lab AS (SELECT DISTINCT id, CASE WHEN external THEN qualified_name ELSE name END AS event FROM all_nodes WHERE kind = 'event'),
pe AS (SELECT l.event, e.kind, s.service, e.id FROM edges e JOIN lab l ON l.id = e.to_id JOIN svc s ON s.id = e.from_id WHERE e.kind IN ('publishes', 'subscribes'))
"""


@registered("to5_event_links", _LINKS + "SELECT a.event, a.service AS from_service, b.service AS to_service, count(DISTINCT a.id) + count(DISTINCT b.id) AS n_edges FROM pe a JOIN pe b ON a.event = b.event AND a.kind = 'publishes' AND b.kind = 'subscribes' GROUP BY ALL")
def event_links_query(g: Graph) -> DataFrame:
    return topology.event_links(g.edges_of("contains", "publishes", "subscribes"), g.nodes_of("event")).select("event", "from_service", "to_service", F.size("edge_ids").cast("long").alias("n_edges"))


@registered(
    "to6_service_links",
    _LINKS
    + """, http AS (SELECT s.service AS from_service, coalesce(t.service, 'external:' || f.target) AS to_service, coalesce(n.name, f.target) AS name, e.resolution AS status, count(DISTINCT e.id) AS n_edges FROM edges e JOIN facts f ON f.id = e.fact_id JOIN svc s ON s.id = e.from_id LEFT JOIN svc t ON t.id = e.to_id LEFT JOIN nodes n ON n.id = e.to_id WHERE e.kind = 'requests' GROUP BY ALL)
SELECT 'http' AS kind, * FROM http UNION ALL SELECT 'event', a.service, b.service, a.event, 'resolved', count(DISTINCT a.id) + count(DISTINCT b.id) FROM pe a JOIN pe b ON a.event = b.event AND a.kind = 'publishes' AND b.kind = 'subscribes' GROUP BY ALL""",
)
def service_links_query(g: Graph) -> DataFrame:
    links = topology.service_topology(g.edges_of("contains", "publishes", "subscribes", "requests"), g.nodes_of("event", "endpoint"), limit=1_000_000)[1]
    return links.select("kind", "from_service", "to_service", "name", "status", F.col("n_edges").cast("long").alias("n_edges"))


# ---- federation -------------------------------------------------------------------


@registered("u2_federated_nodes", "SELECT id, min(external) AS external, arg_min(qualified_name, external) AS qualified_name FROM all_nodes GROUP BY id")
def federated_nodes_query(g: Graph) -> DataFrame:
    return federation.federated_nodes(g.nodes).select("id", "external", "qualified_name")


_PEER_RULES = " OR ".join(f"(e.kind IN ({quoted(es)}) AND n.kind IN ({quoted(ks)}))" for ks, es in _grouped({k: v for k, v in PEER_TARGET_KINDS.items() if k not in ("encodes", "decodes", "carries", "generated_from")}).items())


@registered(
    "fd1_peer_edges",
    f"""SELECT DISTINCT {_SQL.sid('e', 'e.fact_id', 'n.id')} AS id, e.fact_id, e.from_id, n.id AS to_id, e.kind FROM edges e JOIN externals x ON x.id = e.to_id AND x.repository = e.repository
JOIN nodes n ON n.repository <> x.repository AND (x.kind = 'external' OR x.kind = n.kind) AND (x.name IN (n.name, n.qualified_name) OR x.qualified_name IN (n.name, n.qualified_name))
WHERE e.kind NOT IN ('requests', 'encodes', 'decodes', 'carries', 'generated_from') AND (e.kind NOT IN ({quoted(PEER_TARGET_KINDS)}) OR {_PEER_RULES})""",
)
def peer_edges_query(g: Graph) -> DataFrame:
    return federation.rewritten(federation.peer_candidates(g.edges, g.nodes)).select("id", "fact_id", "from_id", "to_id", "kind").distinct()


# ---- incremental ------------------------------------------------------------------


def _replaced(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A source change: the catalogue files lose their tables and their other
    declarations move down one line; owners, new nodes, new facts."""
    owners = g.local.where("path like 'catalog/%'").select("repository", F.col("owner_file").alias("path")).distinct()
    kept = g.local.where("owner_file like 'catalog/%' and kind <> 'table'").withColumn("line", F.col("line") + 1)
    return owners, kept, g.facts.where("owner_file like 'catalog/%'")


@registered("i3_dirty_facts", "SELECT f.id FROM facts f WHERE f.target IN (SELECT name FROM nodes WHERE starts_with(owner_file, 'catalog/') UNION SELECT qualified_name FROM nodes WHERE starts_with(owner_file, 'catalog/')) OR f.target_id IN (SELECT id FROM nodes WHERE starts_with(owner_file, 'catalog/'))")
def dirty_query(g: Graph) -> DataFrame:
    owners, kept, _ = _replaced(g)
    touched = g.local.where("owner_file like 'catalog/%'").select("id", "name", "qualified_name", "kind").unionByName(kept.select("id", "name", "qualified_name", "kind"))
    return incremental.dirty_facts(g.facts, owners, touched)


#: Rows of the tables from which facts are refreshed by parts: what is stored for a part
#: goes before the next. Below, all facts are one part: each part plans and runs all jobs.
MANY_ROWS = 12_000_000
#: The parts: of each, relations whose facts are at most a fifth of all.
PARTS = (
    *((r,) for r in ("calls", "references", "reads", "writes", "imports", "reads_config")),
    tuple(FAILURE_SECTIONS),
    ("declares", "contains"),
    ("publishes", "subscribes", "handled_by", "uses_middleware", "requests"),
)


def parts_of(rows: int) -> tuple[tuple[str, ...], ...]:
    """The parts for tables of so many rows."""
    return PARTS if rows > MANY_ROWS else (tuple(r for p in PARTS for r in p),)


def refresh_differences(g: Graph, parts: tuple[tuple[str, ...], ...]) -> tuple[int, int]:
    """(missing, extra): edges and boundary nodes that an incremental refresh lacks or has
    over a full rebuild. A fact's ends depend on all nodes and on no other fact, so facts
    are taken by ``parts`` of relations; boundary nodes are compared over all parts."""
    spark = g.local.sparkSession
    owners, new_nodes, _ = _replaced(g)
    missing = extra = 0
    wanted, found = [], []
    for relations in parts:
        with passing(spark):
            facts = stored(g.facts_of(*relations), "facts")
            edges, externals = resolve(g.local, facts, "requests" in relations)
            nodes, facts, edges, externals = incremental.refresh(g.local, facts, edges, externals, owners, new_nodes, facts.where("owner_file like 'catalog/%'"))
            full, outside = resolve(nodes, facts, "requests" in relations)
            key = ["repository", "id", "from_id", "to_id", "kind"]
            less, more = incremental.differences(full.select(*key), edges.select(*key))
            missing, extra = missing + less, extra + more
            for side, t in ((wanted, outside), (found, externals)):
                side.append(stored(t.select("repository", ids.packed(F.col("id")).alias("id"), "kind"), "outside", lasting=True))
    union = lambda tables: functools.reduce(DataFrame.unionByName, tables).distinct()
    less, more = incremental.differences(union(wanted), union(found))
    return missing + less, extra + more


@registered("i_refresh_equals_rebuild", "SELECT 0 AS missing, 0 AS extra", raw=True)
def refresh_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that an incremental refresh lacks or has over a full rebuild."""
    rows = sum(table(spark, sf_dir, t).count() for t in ("lineitem", "orders", "events"))
    return spark.createDataFrame([refresh_differences(graph(spark, sf_dir), parts_of(rows))], "missing int, extra int")


@registered(
    "i1_changes",
    "SELECT CASE WHEN c_custkey % 3 = 0 THEN 'changed' WHEN c_custkey % 3 = 1 THEN 'same' ELSE 'removed' END AS change, count(*) AS n FROM customer GROUP BY 1",
    raw=True,
)
def changes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.lit("r").alias("repository"), F.col("c_name").alias("path"), F.col("c_mktsegment").alias("hash"), "c_custkey")
    new = c.where("c_custkey % 3 <> 2").withColumn("hash", F.when(F.col("c_custkey") % 3 == 0, F.concat("hash", F.lit("!"))).otherwise(F.col("hash")))
    return incremental.changes(c, new).groupBy("change").agg(F.count("*").alias("n"))


@registered("sk5_upsert", "SELECT o_custkey AS k, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey", raw=True)
def upsert_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.upsert(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey").select(F.col("o_custkey").alias("k"), "o_orderkey")


@registered("sk7_sweep", "SELECT DISTINCT x.repository, x.id FROM externals x JOIN edges e ON e.repository = x.repository AND e.kind = 'reads' AND (e.from_id = x.id OR e.to_id = x.id)")
def sweep_query(g: Graph) -> DataFrame:
    return incremental.sweep(g.externals_of(relations=("reads",)), g.edges_of("reads").where("kind = 'reads'")).select("repository", "id")


# ---- search and vectors -----------------------------------------------------------

PATTERNS = ("password", "license", "idiot")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("repository"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))


@registered(
    "s3_line_hits",
    f"SELECT source AS repository, CAST(doc_id AS VARCHAR) AS path, pattern, CAST(sum((length(text) - length(replace(text, pattern, ''))) // length(pattern)) AS BIGINT) AS n FROM documents, (SELECT unnest([{quoted(PATTERNS)}]) AS pattern) WHERE contains(text, pattern) GROUP BY ALL",
    raw=True,
)
def hits_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.line_hits(_files(spark, sf_dir), list(PATTERNS)).groupBy("repository", "path", "pattern").agg(F.count("*").alias("n"))


@registered(
    "s3_search",
    f"""WITH l AS (SELECT source AS repository, CAST(doc_id AS VARCHAR) AS path, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
h AS (SELECT repository, path, CAST(line AS INT) AS line, pattern, t FROM l, (SELECT unnest(['password', 'Public License']) AS pattern) WHERE contains(t, pattern)),
x AS (SELECT *, row_number() OVER (PARTITION BY repository, path ORDER BY line, pattern) AS f FROM h),
y AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY repository, path, line) AS p FROM x WHERE f <= 10)
SELECT repository, path, line, pattern FROM y WHERE p <= 50 ORDER BY repository, path, line, pattern LIMIT 40""",
    raw=True,
)
def search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_files(spark, sf_dir), ["password", "Public License"], total=40, most_bytes=256 << 10).select("repository", "path", "line", "pattern")


@registered(
    "s5_vector_top_k",
    "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), q.v), 9) AS score FROM embeddings, q ORDER BY list_inner_product(CAST(embedding AS DOUBLE[]), q.v) DESC, vec_id LIMIT 50",
    raw=True,
)
def top_k_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    query = e.where("vec_id = 0").select("embedding").first()["embedding"]
    return semantic.top_k(e.withColumnRenamed("embedding", "vector"), list(query), 50, ["vec_id"]).select("vec_id", F.round("score", 9).alias("score"))


@registered("s_cache_status", "SELECT label AS dimensions, count(*) AS entries, CAST(sum(len(embedding) * 4) AS BIGINT) AS bytes, min(vec_id) AS oldest, max(vec_id) AS newest FROM embeddings GROUP BY label", raw=True)
def cache_status_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.cache_status(_cache(spark, sf_dir)).drop("model")


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit("m").alias("model"), F.lit("1").alias("document_version"), F.col("vec_id").cast("string").alias("content_hash"), F.col("label").alias("dimensions"), F.col("embedding").alias("vector"), F.col("vec_id").alias("last_used_at"))


@registered("s_cache_prune", "WITH c AS (SELECT vec_id, len(embedding) * 4 AS b, coalesce(sum(len(embedding) * 4) OVER (ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(len(embedding) * 4) OVER () AS t FROM embeddings) SELECT CAST(vec_id AS VARCHAR) AS content_hash FROM c WHERE before >= greatest(0, t - 100000)", raw=True)
def prune_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.prune(_cache(spark, sf_dir), 100_000).select("content_hash")


# ---- scalar functions ---------------------------------------------------------------


@registered("f5_stable_ids", f"SELECT p_partkey, {_SQL.sid('n', 'p_type', 'p_name')} AS node_id, {_SQL.sid('e', 'p_brand', 'p_name')} AS edge_id, {_SQL.sid('e', 'p_brand', 'p_name', chr(39) + 'tests' + chr(39))} AS tests_id FROM part", raw=True)
def ids_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", ids.node_id(F.col("p_type"), F.col("p_name")).alias("node_id"), ids.edge_id(F.col("p_brand"), F.col("p_name")).alias("edge_id"), ids.derived_edge_id(F.col("p_brand"), F.col("p_name"), "tests").alias("tests_id"))


@registered("f3_identity_blob", f"SELECT p_partkey, {_SQL.sid('n', 'p_type', 'p_name')} AS id FROM part", raw=True)
def blob_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", ids.from_blob(ids.to_blob(ids.node_id(F.col("p_type"), F.col("p_name")))).alias("id"))


@registered(
    "f_text_functions",
    r"""SELECT page_id, regexp_extract(trim(url), '([^.:/]*)$', 1) AS simple, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded,
regexp_replace(regexp_replace(url, '\.[^./]*$', ''), '/index$', '') AS module, trim(regexp_replace(regexp_replace(regexp_replace(url, '(\p{Ll}|\p{Nd})(\p{Lu})', '\1 \2', 'g'), '[./:_\-()\[\]{},]+', ' ', 'g'), '\s+', ' ', 'g')) AS words,
CASE WHEN lower(url) = 'http' THEN 0 WHEN lower(url) = 'http' THEN 1 WHEN starts_with(lower(url), 'http') THEN 2 ELSE 4 END AS rank FROM pages""",
    raw=True,
)
def text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.simple_name(u).alias("simple"), text.fold_ascii(u).alias("folded"), text.module_name(u).alias("module"), text.split_identifier(u).alias("words"), text.match_rank(u, u, "HTTP").alias("rank"))


@registered("f34_edit_distance", "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey", raw=True)
def distance_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    both = n.select("n_regionkey", F.col("n_name").alias("a")).join(n.select("n_regionkey", F.col("n_name").alias("b")), "n_regionkey")
    return both.select("a", "b", F.levenshtein("a", "b").cast("long").alias("d"))


@registered("g3_extends_name", "SELECT a.id AS child, b.id AS parent FROM nodes a JOIN nodes b ON a.kind IN ('function', 'method', 'test') AND b.kind = 'file' AND a.owner_file = b.path WHERE starts_with(a.qualified_name, b.qualified_name || '.')")
def extends_query(g: Graph) -> DataFrame:
    a = g.local.where("kind in ('function', 'method', 'test')").select(F.col("id").alias("child"), F.col("qualified_name").alias("q"), "owner_file")
    b = g.local.where("kind = 'file'").select(F.col("id").alias("parent"), F.col("qualified_name").alias("p"), F.col("path").alias("owner_file"))
    return a.join(b, "owner_file").where(text.extends_name(F.col("q"), F.col("p"))).select("child", "parent")


@registered("a11_evidence_digest", "SELECT count(*) AS files FROM (SELECT repository, owner_file FROM nodes UNION SELECT repository, owner_file FROM facts)")
def digest_query(g: Graph) -> DataFrame:
    """Files with a digest; equal for shuffled rows (a difference would raise)."""
    one = stored(incremental.evidence_digest(g.local, g.facts), "digest")
    # Each task's rows in another order; a sort of all rows would deal them with all their columns.
    two = incremental.evidence_digest(g.local.sortWithinPartitions(F.desc("id")), g.facts.sortWithinPartitions("id")).withColumnRenamed("digest", "d2")
    same = one.join(two, ["repository", "owner_file"], "full_outer")
    checked = F.when(F.col("digest").eqNullSafe(F.col("d2")), 1).otherwise(F.raise_error(F.lit("digest depends on order")).cast("int"))
    return same.agg(F.sum(checked).cast("long").alias("files"))


@registered("i2_really_changed", "SELECT DISTINCT repository, owner_file AS path FROM nodes WHERE starts_with(owner_file, 'catalog/')")
def really_changed_query(g: Graph) -> DataFrame:
    """Of all files, re-read after the change, those whose evidence differs."""
    owners, nodes, facts = _replaced(g)
    old = incremental.evidence_digest(g.local, g.facts)
    new = incremental.evidence_digest(incremental.replace_owners(g.local, nodes, owners), incremental.replace_owners(g.facts, facts, owners))
    return incremental.really_changed(old.select("repository", F.col("owner_file").alias("path")), old, new)


@registered("a4_pending", "SELECT count(*) > 0 AS pending FROM nodes WHERE kind = 'table'")
def pending_query(g: Graph) -> DataFrame:
    """Whether a file of the ledger is gone once the tables' files are."""
    files = g.local.select("repository", F.col("owner_file").alias("path"), F.lit("h").alias("hash")).distinct()
    left = files.join(g.local.where("kind = 'table'").select("repository", F.col("owner_file").alias("path")).distinct(), ["repository", "path"], "left_anti")
    return incremental.pending(files, left)


# ---- frontends ----------------------------------------------------------------------

#: Small sources over the nations, one line an item: path, text.
_SOURCES = (
    ("conf/{k}.env", "KEY_{k}=1|export LAST_{k}=${{KEY_{k}}}|"),
    ("db/{k}.sql", "CREATE TABLE t_{k} (id INT PRIMARY KEY, name TEXT);|CREATE VIEW v_{k} AS SELECT t_{k}.id FROM t_{k};|"),
    ("docs/{k}.md", "# Nation {k}||See [next]({n}.md#nation-{n}).||## Part|"),
    ("src/mod{k}.py", "from src.mod{n} import f{n}|||def f{k}(x):|    return g{k}(x)|||def g{k}(y):|    return f{n}(y)|"),
    ("p/{k}.proto", 'syntax = "proto3";|package p{k};|message M {{ int32 a = 1; N b = 2; }}|message N {{ string c = 1; }}|'),
    ("go/{k}.go", "package m|type Box struct {{|\tW int|}}|func H{k}(a int) {{|\tG{k}(a)|}}|func G{k}(b int) {{|}}|"),
    ("web/{k}.ts", "export class C{k} {{|  run(x) {{|    help{k}(x)|  }}|}}|export function help{k}(y) {{|  return y|}}|"),
)
#: What the sources declare: kind, qualified name, line; then edges between names.
_DECLARED = (
    ("config_key", "config:conf/{k}.env:KEY_{k}", 1), ("config_key", "config:conf/{k}.env:LAST_{k}", 2),
    ("table", "t_{k}", 1), ("column", "t_{k}.id", 1), ("column", "t_{k}.name", 1), ("view", "v_{k}", 2),
    ("document_section", "docs/{k}.md#nation-{k}", 1), ("document_section", "docs/{k}.md#part", 5),
    ("module", "src.mod{k}", 1), ("function", "src.mod{k}.f{k}", 4), ("parameter", "src.mod{k}.f{k}.x", 4), ("function", "src.mod{k}.g{k}", 8), ("parameter", "src.mod{k}.g{k}.y", 8),
    ("type", "p{k}.M", 3), ("field", "p{k}.M.a", 3), ("field", "p{k}.M.b", 3), ("type", "p{k}.N", 4), ("field", "p{k}.N.c", 4),
    ("module", "go/{k}", 1), ("type", "go/{k}.Box", 2), ("field", "go/{k}.Box.W", 3), ("function", "go/{k}.H{k}", 5), ("parameter", "go/{k}.H{k}.a", 5), ("function", "go/{k}.G{k}", 8), ("parameter", "go/{k}.G{k}.b", 8),
    ("module", "web/{k}", 1), ("class", "web/{k}.C{k}", 1), ("method", "web/{k}.C{k}.run", 2), ("parameter", "web/{k}.C{k}.run.x", 2), ("function", "web/{k}.help{k}", 6), ("parameter", "web/{k}.help{k}.y", 6),
)
_RELATED = (
    ("references", "config:conf/{k}.env:LAST_{k}", "config:conf/{k}.env:KEY_{k}"), ("reads", "v_{k}", "t_{k}"), ("reads", "v_{k}", "t_{k}.id"), ("has_field", "t_{k}", "t_{k}.id"), ("has_field", "t_{k}", "t_{k}.name"),
    ("documents", "docs/{k}.md#nation-{k}", "docs/{n}.md#nation-{n}"), ("contains", "docs/{k}.md#nation-{k}", "docs/{k}.md#part"),
    ("calls", "src.mod{k}.f{k}", "src.mod{k}.g{k}"), ("calls", "src.mod{k}.g{k}", "src.mod{n}.f{n}"), ("passes", "src.mod{k}.f{k}.x", "src.mod{k}.g{k}"), ("passes", "src.mod{k}.g{k}.y", "src.mod{n}.f{n}"),
    ("returns", "src.mod{k}.f{k}.x", "src.mod{k}.f{k}"), ("returns", "src.mod{k}.g{k}.y", "src.mod{k}.g{k}"),
    ("has_field", "p{k}.M", "p{k}.M.a"), ("has_field", "p{k}.M", "p{k}.M.b"), ("has_field", "p{k}.N", "p{k}.N.c"),
    ("has_field", "go/{k}.Box", "go/{k}.Box.W"), ("calls", "go/{k}.H{k}", "go/{k}.G{k}"), ("passes", "go/{k}.H{k}.a", "go/{k}.G{k}"),
    ("calls", "web/{k}.C{k}.run", "web/{k}.help{k}"), ("passes", "web/{k}.C{k}.run.x", "web/{k}.help{k}"), ("returns", "web/{k}.help{k}.y", "web/{k}.help{k}"),
)


def _filled(template: str) -> str:
    """SQL text of a template over a nation's key ``k`` and its successor ``n``."""
    text = template.replace("'", "''").replace("{k}", "' || k || '").replace("{n}", "' || n || '")
    return "'" + text.replace("{{", "{").replace("}}", "}") + "'"


_NATIONS = "(SELECT CAST(n_nationkey AS STRING) AS k, CAST((n_nationkey + 1) % 25 AS STRING) AS n FROM nation) AS nations"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repository, path, content) of the small sources."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    parts = [spark.sql(f"SELECT 'shop' AS repository, {_filled(p)} AS path, replace({_filled(t)}, '|', chr(10)) AS content FROM {_NATIONS}") for p, t in _SOURCES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@registered("sc_declarations", " UNION ALL ".join(f"SELECT '{kind}' AS kind, {_filled(name)} AS qualified_name, CAST({line} AS BIGINT) AS line FROM {_NATIONS}" for kind, name, line in _DECLARED), raw=True)
def declarations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _, _ = extract(sources(spark, sf_dir))
    return nodes.where("kind <> 'file'").select("kind", "qualified_name", F.col("line").cast("long").alias("line"))


@registered("sc_relations", " UNION ALL ".join(f"SELECT '{kind}' AS kind, {_filled(a)} AS source, {_filled(b)} AS target FROM {_NATIONS}" for kind, a, b in _RELATED), raw=True)
def relations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved edges between the declarations."""
    nodes, facts, _ = extract(sources(spark, sf_dir))
    nodes, facts = stored(nodes, "nodes"), stored(facts, "facts")
    edges, _ = resolve(nodes, facts, http=False)
    names = nodes.where("kind <> 'file'").select("id", "qualified_name")
    ends = edges.join(names.withColumnsRenamed({"id": "from_id", "qualified_name": "source"}), "from_id").join(names.withColumnsRenamed({"id": "to_id", "qualified_name": "target"}), "to_id")
    kinds = sorted({k for k, *_ in _RELATED})
    return ends.where(F.col("kind").isin(*kinds)).select("kind", "source", "target")


@registered(
    "f21_routes",
    """SELECT url, authority, CASE WHEN path = '' THEN '/' ELSE path END AS path, query, fragment, slash FROM (SELECT url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS authority, rtrim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/') AS path,
regexp_extract(url, '[?]([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment, regexp_matches(url, '^https?://[^/?#]*/[^?#]+/([?#]|$)') AS slash FROM pages)""",
    raw=True,
)
def routes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("r", http.route_info("url"))
    return pages.select("url", *[F.col(f"r.{c}").alias(c) for c in ("authority", "path", "query", "fragment", "slash")])
