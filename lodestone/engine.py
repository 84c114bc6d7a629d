"""One object over an index (or a federation of repositories in it): every tool of
the engine as a method that returns DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import catalog, federation, incremental, match, messageflow, reports, scenes, search, semantic, topology, traverse
from .operators.resolve import resolve
from .plans.run import Run
from .plans.scratch import stored
from .plans.ship import ship
from .sources import discover
from .sources.extract import extract
from .sources.store import Store


class Engine:
    def __init__(self, nodes: DataFrame, facts: DataFrame, edges: DataFrame, files: DataFrame | None = None, federated: bool = False):
        self.spark: SparkSession = nodes.sparkSession
        ship(self.spark)
        self.nodes, self.facts, self.files = nodes, facts, files
        self.edges = stored(federation.federated_edges(edges, nodes), "federated") if federated else edges
        self.federated = federated
        self.report = self.problems = self.skipped = None  # of the run that made it

    @classmethod
    def open(cls, store: Store, federated: bool = False) -> Engine:
        t = store.read()
        return cls(t["nodes"], t["facts"], t["edges"], t["files"], federated)

    @classmethod
    def index(cls, spark: SparkSession, roots: dict[str, str], store: Store | None = None, config: dict | None = None) -> Engine:
        """Read, extract and resolve folders (repository -> path); with ``store``
        publish the result. The engine carries ``report`` (phase, seconds, rows),
        ``problems`` (diagnostics of the frontends) and ``skipped`` (files not read)."""
        ship(spark)
        config = config or {}
        scope = config.get("index", {})
        parts = [discover.read_files(spark, path, name, scope.get("include"), scope.get("exclude")) for name, path in roots.items()]
        files = parts[0]
        for p in parts[1:]:
            files = files.unionByName(p)
        files = stored(files, "files")
        report = Run()
        report.add("discover", files)
        nodes, facts, problems = extract(files, config.get("adapters"))
        report.add("extract", nodes)
        for name, path in roots.items():
            about = {} if "://" in path and not path.startswith("file://") else discover.project(path.removeprefix("file://"))
            n, f = discover.components(spark, files.where(F.col("repository") == name), name, config, about)
            nodes, facts = nodes.unionByName(n), facts.unionByName(f)
        nodes, facts = stored(nodes.dropDuplicates(["repository", "id"]), "nodes"), stored(facts.dropDuplicates(["id"]), "facts")
        report.add("facts", facts)
        edges, externals = resolve(nodes, facts)
        edges = stored(edges, "edges")
        report.add("resolve", edges)
        everything = nodes.unionByName(externals.select(*nodes.columns))
        digests = incremental.evidence_digest(nodes, facts).withColumnRenamed("owner_file", "path")
        ledger = files.join(digests, ["repository", "path"], "left").select("repository", "path", "hash", F.lit("").alias("language"), "size", "modified_ns", F.coalesce("digest", F.lit("")).alias("evidence_digest"))
        if store is not None:
            store.write(everything, facts, edges, ledger)
            made = cls.open(store, len(roots) > 1)
            report.add("publish", made.nodes)
        else:
            made = cls(everything, facts, edges, files, len(roots) > 1)
        made.report = report.rows(spark)
        made.problems = problems
        made.skipped = files.where("skipped is not null").select("repository", "path", "skipped")
        return made

    # ---- symbols ---------------------------------------------------------------

    def _ids(self, selectors: list[str], kind: str = "") -> DataFrame:
        """(root): the ids that selectors mean; one that is missing or ambiguous
        raises, with its status."""
        selectors = scenes.resource_selectors(self.nodes, selectors, kind)
        asked = self.spark.createDataFrame([(s,) for s in selectors], "selector string")
        rows = match.resolve_selectors(self.nodes, asked, kind).collect()  # one row a selector
        if bad := {r["selector"]: r["status"] for r in rows if r["status"] != "found"}:
            raise LookupError(f"not found or ambiguous: {bad}")
        return self.spark.createDataFrame([(r["id"],) for r in rows], "root string")

    def find_symbols(self, term: str, limit: int = 20) -> DataFrame:
        return match.find(self.nodes, term, limit, self.federated)

    def get_node(self, selectors: list[str], kind: str = "") -> DataFrame:
        asked = self.spark.createDataFrame([(i, s) for i, s in enumerate(selectors)], "position int, selector string")
        found = match.resolve_selectors(self.nodes, asked.select("selector"), kind)
        return match.batch(asked, found).join(reports.one_per_id(self.nodes), "id", "left").orderBy("position")

    def get_source(self, selectors: list[str], context: int = 2, most_lines: int = 200) -> DataFrame:
        asked = self.nodes.join(self._ids(selectors).withColumnRenamed("root", "id"), "id", "left_semi")
        return search.excerpt(asked, self.edges, self.files, context, most_lines)

    # ---- traversals ------------------------------------------------------------

    def get_neighbors(self, selectors: list[str], direction: str = "both", relations: tuple[str, ...] = (), depth: int = 1, limit: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
        return traverse.neighborhood(self.edges, self._ids(selectors), direction, relations, depth, limit)

    def get_callers(self, selectors: list[str], depth: int = 3, limit: int = 1000) -> DataFrame:
        return traverse.callers(self.edges, self._ids(selectors), depth, limit)[0]

    def get_callees(self, selectors: list[str], depth: int = 3, limit: int = 1000) -> DataFrame:
        return traverse.callees(self.edges, self._ids(selectors), depth, limit)[0]

    def find_path(self, source: str, target: str, direction: str = "out", relations: tuple[str, ...] = ()) -> DataFrame:
        a, b = (self._ids([s]).first()["root"] for s in (source, target))
        pairs = self.spark.createDataFrame([("path", a, b)], "pair string, src string, dst string")
        return traverse.shortest_paths(self.edges, pairs, direction, relations).orderBy("step")

    def get_blast_radius(self, selectors: list[str], depth: int = 4, limit: int = 1000) -> dict[str, DataFrame]:
        return reports.impact(self.edges, self.nodes, self._ids(selectors), depth, limit)

    def get_failure_flow(self, selectors: list[str], direction: str = "both", limit: int = 1000) -> DataFrame:
        return reports.failure_flow(self.edges, self.nodes, self._ids(selectors), direction, limit)

    def get_test_coverage(self, selectors: list[str], depth: int = 8, limit: int = 100) -> tuple[DataFrame, DataFrame]:
        return reports.test_coverage(self.edges, self.nodes, self._ids(selectors), False, depth, limit)

    def find_tests(self, selectors: list[str], depth: int = 8, limit: int = 100) -> tuple[DataFrame, DataFrame]:
        return reports.test_coverage(self.edges, self.nodes, self._ids(selectors), True, depth, limit)

    def get_composition(self, selectors: list[str], limit: int = 1000) -> DataFrame:
        return reports.scene_composition(self.edges, self.nodes, self._ids(selectors), limit=limit)

    def get_interactions(self, selectors: list[str], category: str = "", direction: str = "both", limit: int = 1000) -> DataFrame:
        return reports.interactions(self.edges, self.nodes, self._ids(selectors), category, direction, limit)

    # ---- catalogs --------------------------------------------------------------

    def list_data_resources(self, kinds: list[str] | None = None, **options) -> DataFrame:
        match.data_resources(self.nodes, kinds)
        return catalog.catalog(self.nodes, list(kinds or ("table", "view")), **options)

    def get_data_resource_usage(self, selector: str, limit: int = 1000) -> DataFrame:
        return catalog.data_resource_usage(self.edges, self.nodes, catalog.select_resource(self.nodes, selector), limit)

    def list_config_keys(self, name: str = "", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
        keys = catalog.config_keys(self.nodes, name, limit)
        return keys, catalog.config_usage(self.edges, self.nodes, keys)

    def list_events(self, name: str = "", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
        events = catalog.catalog(self.nodes, ["event"], name, limit=limit)
        return events, catalog.event_usage(self.edges, self.nodes, events)

    def find_orphaned_events(self) -> DataFrame:
        return catalog.orphaned_events(self.edges, self.nodes)

    # ---- topology --------------------------------------------------------------

    def list_endpoints(self, method: str = "", route: str = "") -> tuple[DataFrame, DataFrame]:
        found = topology.endpoints(self.nodes, method, route)
        return found, topology.endpoint_sites(self.edges, self.nodes, found)

    def list_external_requests(self, after: tuple[str, str, str] | None = None, limit: int | None = None) -> DataFrame:
        return topology.external_requests(self.edges, self.nodes, after, limit)

    def list_outbound_requests(self, repositories: list[str] | None = None) -> DataFrame:
        return topology.outbound_requests(self.edges, self.nodes, repositories)

    def find_handler(self, method: str = "", route: str = "", event: str = "") -> DataFrame:
        subjects = topology.endpoints(self.nodes, method, route).select("id") if route else None
        if event:
            named = catalog.catalog(self.nodes, ["event"], event).select("id")
            subjects = named if subjects is None else subjects.unionByName(named)
        if subjects is None:
            raise ValueError("a route or an event is needed")
        return topology.handlers(self.edges, self.nodes, subjects)

    def get_service_topology(self, **scope) -> tuple[DataFrame, DataFrame]:
        return topology.service_topology(self.edges, self.nodes, **scope)

    def get_message_flow(self, messages: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
        ids = self._ids(messages, "type").withColumnRenamed("root", "id")
        found = messageflow.coverage(self.edges, self.nodes, ids)
        return *found, messageflow.evidence(self.edges, self.nodes, ids)

    def list_message_coverage(self, package: str = "", status: str = "", component: str = "", limit: int = 1000) -> DataFrame:
        return messageflow.message_coverage(self.edges, self.nodes, package, status, component, limit)

    # ---- search and status -----------------------------------------------------

    def search_source(self, patterns: list[str], **options) -> DataFrame:
        return search.search(self.files, patterns, **options)

    def find_reusable_code(self, query: list[float], embeddings: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
        return semantic.reusable(match.candidate_nodes(self.nodes), embeddings, query, **options)

    def get_index_status(self) -> DataFrame:
        parts = [t.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(w).alias("what"), "kind", "n") for w, t in (("nodes", self.nodes), ("facts", self.facts), ("edges", self.edges))]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])
