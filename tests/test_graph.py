import itertools
import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import catalog, federation, incremental, match, messageflow, reports, traverse
from lodestone.operators.resolve import resolve
from lodestone.plans.scratch import passing, stored

from .graphs import fact, frames, node


def build(spark, nodes, facts):
    n, f = frames(spark, nodes, facts)
    e, x = resolve(n, f)
    return n.unionByName(x.select(*n.columns)).cache(), f, e.cache()


def roots(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "root string")


def star(spark, arms, links=()):
    ns = {c: node("function", c, f"p.{c}") for c in arms}
    return ns, build(spark, list(ns.values()), [fact("calls", ns[a][1], target_id=ns[b][1], line=i + 1) for i, (a, b) in enumerate(links)])


def test_limit_keeps_edges_and_flags(spark):
    ns, (_, _, e) = star(spark, "abcdef", [("a", x) for x in "bcdef"])
    nodes, edges, flags = traverse.neighborhood(e, roots(spark, ns["a"][1]), "out", (), 1, 3)
    assert nodes.count() == 3 and edges.count() == 5 and flags.first()["truncated"]
    want = sorted(ns[x][1] for x in "bcdef")[:2]
    assert sorted(r.id for r in nodes.where("depth = 1").collect()) == want


def test_cycle_and_depth(spark):
    ns, (_, _, e) = star(spark, "ab", [("a", "b"), ("b", "a")])
    nodes, edges, flags = traverse.neighborhood(e, roots(spark, ns["a"][1]), "out", (), 5)
    assert {r.id: r.depth for r in nodes.collect()} == {ns["a"][1]: 0, ns["b"][1]: 1}
    assert edges.count() == 2 and not flags.first()["truncated"]


def test_shortest_path_takes_first_discovered(spark):
    ns, (_, _, e) = star(spark, "abcd", [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])
    pairs = spark.createDataFrame([("p", ns["a"][1], ns["d"][1]), ("q", ns["d"][1], ns["a"][1]), ("s", ns["a"][1], ns["a"][1])], "pair string, src string, dst string")
    rows = {(r.pair, r.step): r.id for r in traverse.shortest_paths(e, pairs).collect()}
    assert rows[("p", 1)] == min(ns["b"][1], ns["c"][1]) and ("q", 0) not in rows and rows[("s", 0)] == ns["a"][1]


def resolved(spark, nodes, selector):
    n, _ = frames(spark, nodes, [])
    return match.resolve_selectors(n, spark.createDataFrame([(selector,)], "selector string")).first()


def test_selectors(spark):
    strict, loose = node("method", "impact", "App.impact"), node("method", "Impact", "Service.Impact")
    assert resolved(spark, [strict, loose], "impact").id == strict[1]
    f, p = node("function", "f", "P.f"), node("parameter", "f", "P.f.f")
    assert resolved(spark, [f, p], "f").id == f[1]
    t, m = node("type", "Charge", "pkg.Charge"), node("method", "Charge", "pkg.Charge.Charge")
    assert resolved(spark, [t, m], "Charge").status == "ambiguous"
    assert resolved(spark, [t], t[1]).id == t[1] and resolved(spark, [t], "zzz").status == "missing"


def test_members_and_impact(spark):
    c, m, u = node("class", "C", "p.C"), node("method", "m", "p.C.m"), node("function", "u", "p.u", path="b.src")
    n, f, e = build(spark, [c, m, u], [fact("declares", c[1], target_id=m[1]), fact("calls", u[1], target_id=m[1], path="b.src")])
    got = reports.impact(e, n, roots(spark, c[1]))
    up = {r.id: r.depth for r in got["nodes"].where("direction = 'upstream'").collect()}
    assert up == {c[1]: 0, m[1]: 1, u[1]: 2}
    assert {r.path for r in got["files"].collect()} >= {"a.src", "b.src"}


def test_failure_flow_sections(spark):
    f, g, t = node("function", "f"), node("function", "g"), node("type", "E")
    n, _, e = build(spark, [f, g, t], [fact(k, f[1], target_id=t[1], line=i) for i, k in enumerate(["returns_error", "wraps_error", "panics"])])
    rows = reports.failure_flow(e, n, roots(spark, f[1])).collect()
    assert {r.section for r in rows} == {"error_returns", "escaping", "panics"} and not any(r.truncated for r in rows)


def test_coverage_passes_helpers_only(spark):
    t, h, c, d = node("test", "T"), node("function", "H", properties={"test_role": "helper"}), node("function", "C"), node("function", "D")
    n, _, e = build(spark, [t, h, c, d], [fact("calls", a[1], target_id=b[1], line=i) for i, (a, b) in enumerate([(t, h), (h, c), (c, d)])])
    paths, flags = reports.test_coverage(e, n, roots(spark, t[1]))
    assert {(r.id, r.depth) for r in paths.collect()} == {(c[1], 2)} and not flags.first()["truncated"]
    back, _ = reports.test_coverage(e, n, roots(spark, c[1]), reverse=True)
    assert [r.id for r in back.collect()] == [t[1]]


def test_orphans_and_withheld(spark):
    u, d, k = node("function", "u"), node("event", "ev"), node("config_key", "K", properties={"value": "x", "format": "env"})
    n, _, e = build(spark, [u, d, k], [fact("publishes", u[1], target_id=d[1]), fact("subscribes", u[1], target="other", target_kind="event")])
    got = {r.qualified_name: (r.condition, r.status) for r in catalog.orphaned_events(e, n).collect()}
    assert got == {"ev": ("published_without_consumer", "confirmed"), "other": ("consumed_without_producer", "unknown")}
    row = catalog.config_keys(n).first()
    assert row.properties == {"format": "env"} and row.withheld_properties == ["value"]


def test_resource_selection(spark):
    n, _ = frames(spark, [node("table", "users", "db.users"), node("view", "v", "a.v"), node("view", "v", "b.v")], [])
    assert catalog.select_resource(n, "USERS").first().qualified_name == "db.users"
    for bad in ("v", "nothing"):
        with pytest.raises(LookupError):
            catalog.select_resource(n, bad)


def test_federation(spark):
    a, b = node("function", "caller", "a.caller", repo="r1"), node("function", "lib", "b.lib", repo="r2", path="b.src")
    n, _, e = build(spark, [a, b], [fact("calls", a[1], target="x.missing", repo="r1"), fact("requests", a[1], target="GET /p", target_kind="endpoint", repo="r1", line=2)])
    assert federation.federated_edges(e, n).count() == e.count()
    outside = n.where("external and kind = 'external'").withColumn("name", F.lit("b.lib"))
    n2 = n.where("not (external and kind = 'external')").unionByName(outside).unionByName(frames(spark, [node("endpoint", "GET /p", "e", repo="r2", path="b.src")], [])[0])
    moved = {r.kind: r for r in federation.federated_edges(e, n2).collect()}
    assert moved["calls"].to_id == b[1] and moved["calls"].properties["federated"] == "true" and moved["calls"].fact_id == e.where("kind = 'calls'").first().fact_id
    assert moved["requests"].properties["http_destination_evidence"] == "federated"


def test_incremental_equals_full(spark):
    t, h, c = node("test", "T", path="t.src"), node("function", "C", "p.C", path="c.src"), node("function", "C", "q.C", path="d.src")
    facts = [fact("calls", t[1], target="C", path="t.src")]
    n, f = frames(spark, [t, h, c], facts)
    e, x = resolve(n, f)
    key = lambda df: sorted((r.id, r.to_id) for r in df.collect())
    for owners, new in itertools.product([["d.src"], ["c.src", "d.src"]], [[], [node("function", "C", "z.C", path="d.src")]]):
        gone = spark.createDataFrame([("r", p) for p in owners], "repository string, path string")
        fresh, none = frames(spark, new, [])
        n2, f2, e2, x2 = incremental.refresh(n, f, e, x.select(*n.columns), gone, fresh, none)
        full, outside = resolve(n2, f2)
        assert key(e2) == key(full) and {r.id for r in x2.collect()} == {r.id for r in outside.collect()}


def test_refresh_stores_new_rows_only(spark, monkeypatch):
    t, c = node("test", "T", path="t.src"), node("function", "C", "p.C", path="c.src")
    n, f = frames(spark, [t, c], [fact("calls", t[1], target="C", path="t.src")])
    e, x = resolve(n, f)
    tags = []
    monkeypatch.setattr(incremental, "stored", lambda df, tag: (tags.append(tag), stored(df, tag))[1])
    gone = spark.createDataFrame([("r", "c.src")], "repository string, path string")
    n2, f2, _, _ = incremental.refresh(n, f, e, x.select(*n.columns), gone, *frames(spark, [], []))
    assert not {"nodes", "facts"} & set(tags) and n2.count() == 1 and f2.count() == 1


def test_differences_counts_rows_less_and_more(spark):
    rows = lambda *x: spark.createDataFrame([(i, str(i)) for i in x], "a long, b string")
    assert incremental.differences(rows(*range(200), 7), rows(*range(199, -1, -1), 7)) == (0, 0)
    assert incremental.differences(rows(1, 2, 2, 3), rows(2, 3, 3, 4, 5)) == (2, 3)
    assert incremental.differences(rows(), rows(1)) == (0, 1)


def test_tables_of_a_block_go_with_it(spark):
    with passing(spark):
        inner, outer = stored(spark.range(5), "t"), stored(spark.range(5), "t", lasting=True)
        paths = [t.inputFiles()[0].removeprefix("file://") for t in (inner, outer)]
        assert inner.count() == 5
    assert not os.path.exists(paths[0]) and os.path.exists(paths[1]) and outer.count() == 5


def test_evidence_digest_ignores_order(spark):
    rows = [node("function", c) for c in "abc"]
    one, two = (incremental.evidence_digest(*frames(spark, r, [])).first().digest for r in (rows, rows[::-1]))
    assert one == two


def message_graph(spark, extra=()):
    m = node("type", "M", "p.M", properties={"declaration": "message"}, language="protobuf")
    fld = node("field", "x", "p.M.x", language="protobuf")
    g, enc, dec = node("type", "MGo", properties={"generator": "protoc-gen-go"}), node("function", "enc"), node("function", "dec")
    ops = {d: node("transport_operation", d, properties={"direction": d, "payload_status": "proven", "channel_status": "proven", "channel": ch}) for d, ch in (("send", "1"), ("receive", "2"))}
    facts = [fact("generated_from", g[1], target_id=m[1]), fact("has_field", m[1], target_id=fld[1]), fact("encodes", enc[1], target_id=m[1]), fact("decodes", dec[1], target_id=m[1]), fact("writes", enc[1], target_id=fld[1]), fact("carries", ops["send"][1], target_id=m[1])]
    facts += [fact(k, ops["receive"][1], target_id=m[1], line=9) for k in extra]
    return m, build(spark, [m, fld, g, enc, dec, *ops.values()], facts)


def test_message_flow(spark):
    m, (n, _, e) = message_graph(spark)
    ids = spark.createDataFrame([(m[1],)], "id string")
    flows, members = messageflow.coverage(e, n, ids)
    row, part = flows.first(), members.first()
    assert (row.status, row.n_encoder, row.n_send, list(row.gaps)) == ("missing_evidence", 1, 1, []) and part.gap == "produced_without_consumer"
    _, (n, _, e) = message_graph(spark, ["carries"])
    assert list(messageflow.coverage(e, n, ids)[0].first().gaps) == ["channel_mismatch"]
    bare = e.where("kind <> 'generated_from'")
    assert messageflow.coverage(bare, n, ids)[0].first().status == "unknown"
    assert messageflow.message_coverage(e, n, status="missing_evidence").count() == 1
