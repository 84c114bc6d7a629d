import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.functions import http, ids, text
from lodestone.vocab import EDGE_KINDS, NODE_KINDS, checked_kind


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_vocabulary_is_closed():
    assert len(NODE_KINDS) == 31 and len(EDGE_KINDS) == 45
    assert checked_kind(" Function ") == "function" and checked_kind("") == ""
    with pytest.raises(ValueError):
        checked_kind("gadget")


def test_stable_ids(spark):
    want = "n:" + hashlib.sha256(b"function\0a.b\0").hexdigest()[:20]
    assert ids.py_stable_id("n", "function", "a.b") == want
    assert one(spark, ids.node_id("function", F.lit("a.b"))) == want
    assert one(spark, ids.derived_edge_id("f", "t", "tests")) != one(spark, ids.edge_id("f", "t"))
    assert one(spark, ids.derived_edge_id("f", "t", "calls")) == one(spark, ids.edge_id("f", "t"))
    assert one(spark, ids.from_blob(ids.to_blob(F.lit(want)))) == want
    ids.register_sql(spark)
    assert spark.sql("SELECT edge_id('f', 't')").first()[0] == ids.py_stable_id("e", "f", "t")


@pytest.mark.parametrize("value,want", [("a.b.c", "c"), ("a/b", "b"), (" x:y ", "y"), ("plain", "plain"), ("a.", "")])
def test_simple_name(spark, value, want):
    assert one(spark, text.simple_name(F.lit(value))) == want


def test_names(spark):
    assert one(spark, text.extends_name(F.lit("a.b"), F.lit("a"))) is True
    assert one(spark, text.extends_name(F.lit("ab"), F.lit("a"))) is False
    assert one(spark, text.split_identifier(F.lit("pkg.fooBar/Baz_q"))) == "pkg foo Bar Baz q"
    assert one(spark, text.fold_ascii(F.lit("ÀB"))) == "Àb"
    assert one(spark, text.module_name(F.lit("a/b/index.ts"))) == "a/b"
    assert one(spark, text.unquote(F.lit("'x'"))) == "x"
    assert one(spark, text.properties_text(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2")))) == '{"a":"2","b":"1"}'
    assert one(spark, text.parse_properties(F.lit("{bad"))) == {"_invalid": "{bad"}


@pytest.mark.parametrize("path,glob,want", [("a/b/c.go", "a/**", True), ("a/b/c.go", "**/*.go", True), ("c.go", "**/*.go", True), ("a/b/c.go", "a/*.go", False), ("a/b.go", "a/?.go", True), ("ab/c", "a/**", False)])
def test_globs(spark, path, glob, want):
    assert one(spark, text.in_scope(F.lit(path), [glob], [])) is want
    assert one(spark, text.in_scope(F.lit(path), [], [glob])) is not want


@pytest.mark.parametrize("bad", ["", "/a", "a\\b", "../a", "a/*", "C:/x"])
def test_bad_prefixes(bad):
    with pytest.raises(ValueError):
        text.checked_prefix(bad)


def rank(declared, asked):
    return http.compatibility(http.parse_route(declared), http.parse_route(asked))


@pytest.mark.parametrize(
    "declared,asked,want",
    [
        ("/a/b", "/a/b", http.EXACT), ("/a/b/", "/a/b", http.TEMPLATE), ("/a/{x}", "/a/c", http.TEMPLATE), ("/a/*", "/a/c/d", http.CATCHALL),
        ("/a/*", "/a", http.NONE), ("/a/*", "/a/", http.CATCHALL), ("/a/{x...}", "/a/b", http.CATCHALL), ("/a/{id:[0-9]+}", "/a/12", http.TEMPLATE),
        ("/a/{id:[0-9]+}", "/a/x", http.NONE), ("/a/{id:[0-9]+}", "/a/{n:[0-9]+}", http.TEMPLATE), ("/a/b", "/a/{x}", http.NONE), ("/a/{x}", "/a/*", http.NONE),
        ("/a/{$}", "/a/", http.TEMPLATE), ("/a/{$}", "/a", http.NONE), ("/", "/", http.EXACT), ("/%61", "/a", http.EXACT), ("/a", "/a/b", http.NONE),
    ],
)
def test_route_compatibility(declared, asked, want):
    assert rank(declared, asked) == want


@pytest.mark.parametrize("bad", ["", "a/b", "//a", "/a/../b", "/a/{", "/a/{x...}/b", "/a/{x:}", "/a/{...}", "ftp://h/x", "/a\tb", "/%zz", "/a/{x:[}"])
def test_bad_routes(bad):
    with pytest.raises(http.BadRoute):
        http.parse_route(bad)


def test_route_parts():
    r = http.parse_route("https://H.example/a/{id}?q=1#f")
    assert (r.authority, r.scheme, r.path, r.canonical, r.query, r.fragment) == ("H.example", "https", "/a/{id}", "/a/{_}", "q=1", "f")
    assert http.join_routes("/api/", "/x?q=1").path == "/api/x" and http.join_routes("/api", "/").path == "/api"


def test_destinations(spark):
    legal = lambda *d: one(spark, http.destination_is_legal(*map(F.lit, d)))
    assert legal("local", "resolved", "route") and not legal("external", "resolved", "route") and not legal("local", "resolved", "")
    p = http.with_destination(F.create_map(F.lit("http_destination_resolution"), F.lit("x"), F.lit("k"), F.lit("v")), "resolved", "route")
    assert one(spark, p) == {"k": "v", "http_destination_resolution": "resolved", "http_destination_evidence": "route"}
