import os
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import ids
from lodestone.plans import fixture, queries, scratch

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def kept(spark, monkeypatch):
    """Tags of what the graph keeps in the shared folder, for a graph not known yet."""
    tags = []

    def stored(df, tag):
        tags.append(tag)
        return scratch.stored(df, tag)

    monkeypatch.setattr(fixture, "stored", stored)
    monkeypatch.setattr(fixture, "_KNOWN", {})
    return tags


def test_declarations_need_no_stored_graph(spark, kept):
    for name in ("p3_list_by_kind", "p4_messages", "p11_candidates", "g3_extends_name", "a4_pending"):
        queries.QUERIES[name](spark, SMALL).count()
    assert kept == []


def test_usage_resolves_its_relations_only(spark, kept):
    assert queries.QUERIES["c3_config_usage"](spark, SMALL).count() == 850
    g = fixture.graph(spark, SMALL)
    assert set(g._ends) == {("references",), ("reads_config",)} and "tests" not in kept


def _lines(spark, sql):
    columns = ["repository", "id", "from_id", "kind", "target_id", "target", "target_kind", "path", "line"]
    return spark.sql(sql.facts()).select(*columns)


def test_lines_dealt_once_are_the_same_facts(spark):
    for t in fixture.TABLES:
        spark.read.parquet(f"{SMALL}/{t}.parquet").createOrReplaceTempView(t)
    lines = spark.table("lineitem")
    lines.unionByName(lines.limit(500)).createOrReplaceTempView("lineitem")  # repeated lines are one fact
    assert fixture.plain_keys(spark)
    a, b = _lines(spark, fixture.Sql(fixture.SPARK, True)), _lines(spark, fixture.Sql(fixture.SPARK))
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()
    suppliers = spark.table("supplier")
    suppliers.unionByName(suppliers.limit(1)).createOrReplaceTempView("supplier")
    assert not fixture.plain_keys(spark)  # then repeated facts are dropped after the joins


def test_stored_rows_are_compressed(spark):
    path = scratch.stored(spark.range(1000).groupBy("id").count(), "t").inputFiles()[0]
    assert ".zstd." in os.path.basename(path)


def test_narrow_rows_are_the_same_facts(spark):
    g = fixture.graph(spark, SMALL)
    columns = ["id", "from_id", "kind", "target_id", "target", "target_kind", "path", "line"]
    for kinds in (("calls", "handled_by"), ("contains", "declares", "publishes"), ("reads", "returns_error")):
        a = fixture.spelled(g._rows(*kinds)).select(*columns)
        b = spark.sql(fixture.Sql(fixture.SPARK).facts()).where(F.col("kind").isin(*kinds)).select(*columns)
        assert a.count() == b.count() > 0 and a.exceptAll(b).isEmpty()


def test_keys_without_gaps_need_no_join(spark):
    fixture.registered(spark, SMALL)
    dense, small = fixture.key_ranges(spark)
    assert set(dense) == {"part", "supplier"} and small == {"supplier"}
    names = ["repository", *fixture.NARROW, "kind", "target_id", "target", "target_kind"]
    facts = lambda **known: spark.sql(fixture.Sql(fixture.SPARK, True, **known).narrow()).select(*names)
    a, b = facts(), facts(dense=dense, small=small)
    assert a.count() == b.count() > 0 and a.exceptAll(b).isEmpty()
    plan = spark.sql(fixture.Sql(fixture.SPARK, True, dense, small).narrow(("reads_config",)))._jdf.queryExecution().optimizedPlan().toString()
    assert "p_partkey" not in plan and "s_suppkey" not in plan
    for table, key in (("part", "p_partkey"), ("supplier", "s_suppkey")):  # with a gap they are joined
        spark.table(table).where(f"{key} <> 3").createOrReplaceTempView(table)
    assert fixture.key_ranges(spark)[0] == {}


def test_counts_resolve_only_derived_edges(spark, kept):
    counts = {r.what: r.n for r in queries.QUERIES["a5_federated_counts"](spark, SMALL).collect()}
    assert "ended" not in kept
    g = fixture.graph(spark, SMALL)
    assert counts == {"nodes": g.nodes.count(), "facts": g.facts.count(), "edges": g.edges.count()}


def test_term_that_no_id_holds_reads_no_called_orders(spark):
    g = fixture.graph(spark, SMALL)
    held = lambda term: g._rows("calls", "declares", holding=term).where("target_id <> ''").count()
    assert held("blue") == 0 < held("n:a") and held("%") == held("")


def test_find_resolves_only_what_the_term_can_name(spark, kept):
    g = fixture.graph(spark, SMALL)
    rows = g.externals_of(holding="Red_W").collect()
    assert rows and all(re.search("red.w", r["qualified_name"].lower()) for r in rows)
    assert "ended" not in kept


def test_digest_sorts_within_tasks(spark):
    frame = queries.QUERIES["a11_evidence_digest"](spark, SMALL)
    assert "rangepartitioning" not in frame._jdf.queryExecution().executedPlan().toString()


def test_refresh_goes_by_parts_of_large_tables_only():
    one, many = queries.parts_of(5_100_000), queries.parts_of(51_000_000)
    assert len(one) == 1 and many == queries.PARTS
    assert set(one[0]) == {r for p in many for r in p} == {r for relations, _ in fixture.GROUPS for r in relations} | {fixture.REQUESTS}


def test_packed_ids_come_back(spark):
    texts = ["n:0123456789abcdef0123", "n:missing", "", "repository:x", "N:0123456789ABCDEF0123"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ids.packed(F.col("t")).alias("p"))
    assert all(r["t"] == r["u"] for r in rows.withColumn("u", ids.unpacked(F.col("p"))).collect())
    assert rows.where(F.col("p").isNotNull()).select("p").distinct().count() == len(texts)
