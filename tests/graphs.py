"""Small graphs for the tests."""

from lodestone.functions.ids import py_stable_id
from lodestone.vocab import FACTS, NODES


def node(kind, name, qn=None, repo="r", path="a.src", line=1, properties=None, external=False, language="x"):
    qn = qn or name
    return (repo, py_stable_id("n", kind, qn, repo, path), kind, name, qn, language, path, line, 0, line, properties or {}, path, external)


def fact(kind, from_id="", target_id="", target="", target_kind="", source="", source_kind="", repo="r", path="a.src", line=1, properties=None):
    key = py_stable_id("f", path, from_id or source, kind, target_id or target, target_kind, line, repo)
    return (repo, key, from_id, source, source_kind, kind, "x", target_id, target, target_kind, path, line, 0, line, properties or {}, path)


def frames(spark, nodes, facts):
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(facts, FACTS)
