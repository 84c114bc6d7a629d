import json

import pytest
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.operators import search, semantic
from lodestone.sources import discover
from lodestone.sources.store import IncompatibleIndex, Store
from lodestone.streaming.watch import apply_changes, watch
from lodestone.vocab import FILES

CODE = {
    "app/service.py": "import os\nfrom app.db import query\n\n\ndef charge(order):\n    query(order)\n    os.getenv('KEY')\n    return order\n",
    "app/db.py": "def query(x):\n    return x\n",
    "tests/test_service.py": "from app.service import charge\n\n\ndef test_charge():\n    charge(1)\n",
    "schema.sql": "CREATE TABLE orders (id INT);\n",
    ".env": "KEY=1\n",
    "node_modules/x.py": "def hidden(): pass\n",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    for path, text in CODE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    store = Store(spark, f"file://{tmp_path_factory.mktemp('index')}/i")
    made = Engine.index(spark, {"shop": str(root)}, store, {"components": [{"name": "app", "root": "app"}]})
    made.store = store
    return made


def names(engine, ids):
    return {r.qualified_name for r in engine.nodes.join(ids.select("id"), "id", "left_semi").collect()}


def test_index_and_queries(engine):
    assert names(engine, engine.get_callers(["app.db.query"])) == {"app.db.query", "app.service.charge", "tests.test_service.test_charge"}
    assert [r.step for r in engine.find_path("test_charge", "app.db.query").collect()] == [0, 1, 2]
    assert engine.get_node(["charge", "zzz"]).collect()[1].error == "missing"
    tests, _ = engine.find_tests(["charge"])
    assert names(engine, tests) == {"tests.test_service.test_charge"}
    keys, usage = engine.list_config_keys()
    assert {r.name for r in keys.collect()} == {"KEY"} and usage.where("relation = 'definitions'").count() == 1
    assert engine.list_data_resources().first().qualified_name == "orders"
    assert not engine.find_symbols("hidden").count()
    assert engine.get_index_status().where("what = 'edges' and kind = 'tests'").first().n == 1
    with pytest.raises(LookupError):
        engine.get_callers(["nothing"])


def test_store_snapshots(engine, spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/kept")
    before = store.copy_from(engine.store)
    store.compact()
    assert store.version() != before and store.inspect().where("current").count() >= 5
    assert store.prune() == [before] and store.read()["nodes"].count() == engine.nodes.count()
    other = Store(spark, store.root + "-copy")
    other.copy_from(store)
    assert other.meta()["seeded_from"] == store.root
    t = other.read()
    other.write(t["nodes"], t["facts"], t["edges"], t["files"], {"schema_version": "0"})
    with pytest.raises(IncompatibleIndex):
        other.read()


def test_stream_of_changes(engine, spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index")
    store.copy_from(engine.store)
    (tmp_path / "in").mkdir()
    change = {"repository": "shop", "path": "app/db.py", "content": "def other(x):\n    return x\n", "hash": "new", "sequence": 1}
    (tmp_path / "in" / "1.json").write_text(json.dumps(change))
    q = watch(spark, f"file://{tmp_path}/in", store, f"file://{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    now = Engine.open(store)
    assert [r.qualified_name for r in now.find_symbols("app.db.other").collect()] == ["app.db.other", "app.db.other.x"]
    far = now.edges.where("kind = 'calls'").join(now.nodes.where("external").select("id"), now.edges["to_id"] == now.nodes["id"])
    assert far.count() >= 1  # charge's call is open again
    assert apply_changes(store, spark.createDataFrame([tuple(change.values())], "repository string, path string, content string, hash string, sequence long")) is None
    assert store.read()["files"].columns == FILES.fieldNames()


def files(spark, *texts):
    return spark.createDataFrame([("r", f"f{i}", t) for i, t in enumerate(texts)], "repository string, path string, content string")


def test_search_columns_caps_and_skips(spark):
    f = files(spark, "é needle needle\nx\nneedle", "needle", None, "\0needle", "n" * 50)
    rows = search.search(f, ["needle"]).collect()
    assert [(r.path, r.line, r.column_no) for r in rows] == [("f0", 1, 4), ("f0", 1, 11), ("f0", 3, 1), ("f1", 1, 1)] and not rows[0].truncated
    assert len(search.search(f, ["needle"], per_file=1).collect()) == 2
    cut = search.search(f, ["needle"], total=2).collect()
    assert len(cut) == 2 and cut[0].truncated
    assert {r.reason for r in search.skipped(f).collect()} == {"unreadable", "binary"}
    assert search.search(f, ["NEEDLE"], ignore_case=True).count() == 4 and search.search(f, ["n..dle$"], regex=True).count() == 3
    for bad in ([], [""], ["x" * 2000], [r"(?=x)"]):
        with pytest.raises(ValueError):
            search.search(f, bad, regex=True)


def test_vectors(spark):
    v = spark.createDataFrame([("a", "q.a", [1.0, 0.0]), ("b", "q.b", [0.6, 0.8]), ("c", "q.c", [0.6, 0.8])], "id string, qualified_name string, vector array<float>")
    assert [r.id for r in semantic.top_k(v, [0.0, 1.0], 2).collect()] == ["b", "c"]
    assert abs(sum(x * x for x in v.select(semantic.normalized(v["vector"]).alias("n")).first().n) - 1) < 1e-6
    with pytest.raises(Exception, match="direction"):
        spark.createDataFrame([([0.0],)], "v array<float>").select(semantic.normalized(F.col("v"))).collect()


def test_configuration():
    assert discover.load_config("components:\n- {name: a, root: x}\n")["components"][0]["root"] == "x"
    for bad in ("nope: 1", "components: [{name: a}]", "index: {include: ['/abs']}", "components:\n- {name: a, root: x}\n- {name: a, root: y}"):
        with pytest.raises(ValueError):
            discover.load_config(bad)
