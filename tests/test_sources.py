import subprocess

import pytest

from lodestone.engine import Engine
from lodestone.operators import incremental, messageflow, scenes
from lodestone.sources import discover, effects
from lodestone.sources.extract import extract, parse_file
from lodestone.sources.store import Store
from lodestone.streaming.watch import CHANGES, apply_changes

from .graphs import fact, frames, node

CONFIG = """
adapters:
  - match: {language: gdscript, symbol: Bus.announce}
    effects:
      - kind: event.publish
        roles: {event: {argument: 0}}
  - match: {language: gdscript, symbol: Bus.listen}
    effects:
      - kind: event.subscribe
        roles: {event: {argument: 0}, handler: {argument: 1}}
      - kind: http.request
        roles: {method: {argument: 2}, url: {argument: 3}}
"""
SCRIPT = """extends Node

func _ready():
    Bus.announce("door, opened", [1, 2])
    Bus.announce(dynamic_name)
    Bus.listen("door_closed", on_door, "get", "/doors")
    Other.announce("not ours")
"""


def test_adapters_add_effects_for_literals_only():
    adapters = discover.load_config(CONFIG)["adapters"]
    added = [f for f in parse_file("r", "a/door.gd", SCRIPT, adapters).facts if "adapter_source" in f["properties"]]
    assert sorted((f["kind"], f["target"], f["target_kind"], f["line"]) for f in added) == [
        ("publishes", "door, opened", "event", 4), ("requests", "GET /doors", "endpoint", 6), ("subscribes", "door_closed", "event", 6),
    ]
    assert {f["properties"].get("handler") for f in added if f["kind"] == "subscribes"} == {"on_door"}
    assert len({f["id"] for f in added}) == 3 and all(f["from_id"] for f in added)
    assert parse_file("r", "a/door.gd", SCRIPT).facts == parse_file("r", "a/door.gd", SCRIPT, []).facts


@pytest.mark.parametrize("text", [
    "adapters: 3",
    "adapters: [{match: {language: cobol, symbol: a.b}, effects: [{kind: event.publish, roles: {event: {argument: 0}}}]}]",
    "adapters: [{match: {language: gdscript, symbol: bare}, effects: [{kind: event.publish, roles: {event: {argument: 0}}}]}]",
    "adapters: [{match: {language: gdscript, symbol: a.b}, effects: []}]",
    "adapters: [{match: {language: gdscript, symbol: a.b}, effects: [{kind: event.eat, roles: {}}]}]",
    "adapters: [{match: {language: gdscript, symbol: a.b}, effects: [{kind: event.subscribe, roles: {event: {argument: 0}}}]}]",
    "adapters: [{match: {language: gdscript, symbol: a.b}, effects: [{kind: event.subscribe, roles: {event: {argument: 0}, handler: {argument: 0}}}]}]",
    "adapters: [{match: {language: gdscript, symbol: a.b}, effects: [{kind: event.publish, roles: {event: {argument: -1}}}]}]",
])
def test_malformed_adapters_raise(text):
    with pytest.raises(ValueError):
        discover.load_config(text)


def test_arguments_of_a_call():
    assert effects.arguments("f(a, 'b,)', [c, (d)], \"e\\\"\")", 1) == ["a", "'b,)'", "[c, (d)]", '"e\\""']
    assert effects.arguments("f()", 1) == [] and effects.arguments("f(a", 1) is None and effects.arguments("f('a", 1) is None


def test_ignore_rules_of_a_checkout(spark, tmp_path):
    (tmp_path / "kept.py").write_text("x = 1\n")
    (tmp_path / "made.py").write_text("x = 2\n")
    paths = lambda: {p for _, p, _, _ in discover.list_files(spark, str(tmp_path))}
    assert paths() == {"kept.py", "made.py"}
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / ".gitignore").write_text("made.py\n")
    assert paths() == {"kept.py", ".gitignore"}


def test_resource_paths():
    assert scenes.identity("./a/b.tscn") == "a/b" and scenes.identity("a/.tscn") == "a/.tscn" and scenes.identity("a.b/c") == "a.b/c"
    assert scenes.resolved("game", "res://x/y.gd") == "game/x/y" and scenes.resolved("", "*res://x.tscn") == "x"
    assert scenes.resolved("game", "res://../other/y.gd") == scenes.resolved("", "../y.gd") == scenes.resolved("game", "uid://abc") == scenes.resolved("game", " ") == ""
    assert scenes.resolved("game", "lib/y.gd") == "lib/y"
    assert scenes.kind_of_path("A.TSCN") == "godot_scene" and scenes.kind_of_path("notes.md") == ""


def test_resource_selectors(spark):
    files = [node("file", "project.godot", f"r:{d}/project.godot", path=f"{d}/project.godot") for d in ("one", "two")]
    made = [node("godot_scene", "main.tscn", f"{d}/main.tscn", path=f"{d}/main.tscn") for d in ("one", "two")]
    only = node("module", "hero", "two/hero", path="two/hero.gd")
    nodes, _ = frames(spark, [*files, *made, only], [])
    assert scenes.resource_selectors(nodes, ["res://hero.gd", "plain", "one/main.tscn", "res://none.tres"]) == [only[1], "plain", made[0][1], "res://none.tres"]
    with pytest.raises(LookupError):
        scenes.resource_selectors(nodes, ["res://main.tscn"])


def test_owners_by_alias(spark):
    part, other = node("component", "app", "component:r:app"), node("component", "web", "component:r:web")
    a, b, c = (node("file", n, f"r:{p}/{n}", path=f"{p}/{n}") for p, n in (("x", "m.py"), ("y", "m.py"), ("y", "n.py")))
    inside, named = node("function", "f", "x.m.f", path="x/m.py"), node("type", "T", "n.py", path="elsewhere")
    weak = node("type", "U", "m.py", path="nowhere")
    nodes, _ = frames(spark, [part, other, a, b, c, inside, named, weak], [])
    edges = spark.createDataFrame([("contains", part[1], a[1]), ("contains", other[1], b[1]), ("contains", other[1], c[1])], "kind string, from_id string, to_id string")
    got = {r.id: r.component for r in messageflow.owners_by_alias(edges, nodes).collect()}
    assert got[part[1]] == part[1] and got[inside[1]] == part[1] and got[named[1]] == other[1]
    assert weak[1] not in got  # two files answer to m.py


def test_evidence_and_ledger(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def f():\n    return 1\n")
    (src / "big.bin").write_bytes(b"\0" * 10)
    store = Store(spark, f"file://{tmp_path}/index")
    made = Engine.index(spark, {"r": str(src)}, store)
    assert [r.phase for r in made.report.collect()] == ["discover", "extract", "facts", "resolve", "publish"]
    assert {(r.path, r.skipped) for r in made.skipped.collect()} == {("big.bin", "binary")}
    about = made.nodes.where("kind = 'repository'").first().properties
    assert about["root"].endswith("src") and "branch" not in about
    held = made.facts.where("kind = 'contains'").collect()
    assert len(held) == 2 and all(f.from_id.startswith("n:") for f in held)
    before = store.read()
    row = lambda text, n: spark.createDataFrame([("r", "a.py", text, f"h{n}", n)], CHANGES)
    files = before["files"]
    assert not incremental.pending(files, files).first().pending and incremental.pending(files, files.limit(0)).first().pending
    # The first change brings the ledger in line; another text of equal evidence touches nothing else.
    apply_changes(store, row("def f():\n    return 2\n", 1))
    one = store.read()
    apply_changes(store, row("def f():\n    return 3\n", 2))
    two = store.read()
    digest = lambda t: t["files"].where("path = 'a.py'").first()
    assert digest(one).evidence_digest == digest(two).evidence_digest != "" and digest(two).hash == "h2"
    ids = lambda t: sorted(r.id for r in t["facts"].collect())
    assert ids(one) == ids(two)


def test_digest_is_free_of_order(spark):
    nodes, facts = frames(spark, [node("function", f"f{i}") for i in range(9)], [fact("calls", target=f"f{i}", source="f0") for i in range(5)])
    a = incremental.evidence_digest(nodes, facts).collect()
    assert a == incremental.evidence_digest(nodes.orderBy("id").repartition(3), facts.orderBy("target")).collect()
    assert a != incremental.evidence_digest(nodes.where("name <> 'f1'"), facts).collect()
    assert extract(spark.createDataFrame([], "repository string, path string, content string"))[0].count() == 0
