import pytest
from lodestone.sources.extract import parse_file


def read(path, text):
    r = parse_file("r", path, text)
    names = {n["id"]: n["qualified_name"] for n in r.nodes}
    return {(n["kind"], n["qualified_name"]) for n in r.nodes}, {(names.get(f["from_id"], f["from_id"]), f["kind"], names.get(f["target_id"], f["target"])) for f in r.facts}, r


def test_python():
    nodes, facts, r = read(
        "pkg/app.py",
        """import os, requests
from lib.db import Client as C

class Service(Base):
    limit: int = 3
    def __init__(self, db: C):
        self.db = db
    def run(self, x):
        y = x
        helper(y)
        self.db.query(y)
        os.getenv("KEY")
        requests.get("/orders")
        bus.publish("made", y)
        return y

@app.get("/items")
def items():
    pass
""",
    )
    assert {("class", "pkg.app.Service"), ("method", "pkg.app.Service.run"), ("field", "pkg.app.Service.db"), ("parameter", "pkg.app.Service.run.x")} <= nodes
    assert {
        ("pkg.app.Service", "extends", "Base"), ("pkg.app.Service.run", "calls", "pkg.app.helper"), ("pkg.app.Service.run", "reads_config", "KEY"), ("pkg.app.Service.run", "requests", "GET /orders"),
        ("pkg.app.Service.run", "publishes", "made"), ("endpoint:GET /items@pkg/app.py:17", "handled_by", "pkg.app.items"), ("r:pkg/app.py", "imports", "lib.db"),
    } <= facts
    assert any(f[1] == "returns" for f in facts) and any(f[1] == "passes" for f in facts)
    assert read("bad.py", "def (")[2].diagnostics[0]["level"] == "error"


def test_config_and_manifests():
    nodes, facts, _ = read(".env", "export A=1\nB=${A}\n")
    assert ("config_key", "config:.env:A") in nodes and ("config:.env:B", "references", "A") in facts
    assert ("config_key", "config:c.yaml:a.b") in read("c.yaml", "a:\n  b: 1\n- x\n")[0]
    assert ("config_key", "config:c.toml:t.k") in read("c.toml", "[t]\nk = 'v'\n")[0]
    assert ("m", "depends_on", "left") in read("package.json", '{"name": "m", "dependencies": {"left": "1"}}')[1]
    assert ("r", "depends_on", "a-b") in read("requirements.txt", "A_b==1.0\n-r x.txt\n")[1]
    assert ("x/y", "depends_on", "a/b") in read("go.mod", "module x/y\nrequire (\n\ta/b v1.0.0\n)\n")[1]


def test_markdown():
    nodes, facts, _ = read("d/a.md", "# Top\ntext [l](../b.md#x)\n## Sub\nfunction `f`\n## Sub\n```\n# no\n```\n")
    assert {("document_section", "d/a.md#top"), ("document_section", "d/a.md#sub"), ("document_section", "d/a.md#sub-1")} <= nodes
    assert {("d/a.md#top", "contains", "d/a.md#sub"), ("d/a.md#top", "documents", "b.md#x"), ("d/a.md#sub", "documents", "f")} <= facts and not any("#no" in n[1] for n in nodes)


def test_sql():
    nodes, facts, _ = read(
        "s.sql",
        "CREATE TABLE users (id INTEGER PRIMARY KEY, org INT NOT NULL REFERENCES orgs(id));\nCREATE VIEW v AS WITH c AS (SELECT 1) SELECT u.id FROM users u JOIN c;\n-- name: AddUser :exec\nINSERT INTO users (id) SELECT id FROM staging;\nDELETE FROM users;",
    )
    assert {("table", "users"), ("column", "users.id"), ("view", "v"), ("sql_query", "s.sql:AddUser")} <= nodes
    assert {("users", "references", "orgs"), ("v", "reads", "users"), ("v", "reads", "users.id"), ("s.sql:AddUser", "writes", "users"), ("s.sql:AddUser", "reads", "staging"), ("r:s.sql", "writes", "users")} <= facts
    assert ("v", "reads", "c") not in facts


def test_protobuf():
    nodes, facts, r = read("m.proto", 'syntax = "proto3";\npackage p;\nimport "o.proto";\nmessage M { string a = 1; repeated N n = 2; oneof k { int32 b = 3; } map<string, N> m = 4; message In { } }\nenum E { Z = 0; }\nservice S { rpc Get (M) returns (stream N); }\n')
    assert {("type", "p.M"), ("type", "p.M.In"), ("field", "p.M.b"), ("field", "p.E.Z"), ("method", "p.S.Get")} <= nodes
    assert {("p.M", "has_field", "p.M.n"), ("p.M.n", "references", "N"), ("p.S.Get", "references", "M"), ("r:m.proto", "imports", "o.proto")} <= facts
    assert next(n for n in r.nodes if n["qualified_name"] == "p.M.b")["properties"]["oneof"] == "k"


def test_syntactic_frontends():
    nodes, facts, _ = read("a/m.go", 'package m\nimport (\n\t"net/http"\n)\ntype T struct {\n}\nfunc (t *T) Run() error {\n\thelper()\n\tdefer t.Close()\n\treturn err\n}\nfunc helper() {}\nfunc TestRun(t *testing.T) {\n\thelper()\n}\n')
    assert {("type", "a/m.T"), ("method", "a/m.T.Run"), ("test", "a/m.TestRun")} <= nodes
    assert {("a/m.T.Run", "calls", "a/m.helper"), ("a/m.T.Run", "propagates_error", "error"), ("a/m.TestRun", "calls", "a/m.helper")} <= facts
    nodes, facts, _ = read("s/c.ts", 'import { x } from "./lib";\nexport class A extends B {\n  run(y: string) {\n    fetch("/orders");\n    x(y);\n  }\n}\napp.get("/p", handler);\n')
    assert {("class", "s/c.A"), ("method", "s/c.A.run")} <= nodes and {("s/c.A", "extends", "B"), ("s/c.A.run", "requests", "GET /orders"), ("r:s/c.ts", "imports", "./lib")} <= facts
    assert any(f[1:] == ("handled_by", "handler") for f in facts)
    assert ("method", "J.J.m") in read("J.java", "class J {\n  void m() {\n    n();\n  }\n}\n")[0]
    assert ("method", "p.S.f") in read("p.swift", "struct S {\n  func f() {\n  }\n}\n")[0]
    assert ("event", "g.hit") in read("g.gd", "extends Node\nsignal hit\nfunc _ready():\n\tpass\n")[0]


def test_scenes():
    text = '[gd_scene format=3]\n[ext_resource type="Script" path="res://p.gd" id="1"]\n[ext_resource type="PackedScene" path="res://e.tscn" id="2"]\n[node name="Root" type="Node"]\nscript = ExtResource("1")\n[node name="E" parent="." groups=["g"] instance=ExtResource("2")]\n[connection signal="hit" from="E" to="." method="on_hit"]\n'
    nodes, facts, _ = read("m.tscn", text)
    assert {("godot_scene", "m.tscn"), ("godot_scene_node", "m.tscn::E")} <= nodes
    assert {("m.tscn::.", "attaches_script", "p"), ("m.tscn::E", "instantiates", "e.tscn"), ("m.tscn::E", "in_group", "g"), ("m.tscn::.", "subscribes", "hit")} <= facts
    nodes, facts, _ = read("project.godot", '[autoload]\nGame="*res://g.gd"\n[input]\njump={\n')
    assert ("autoload:Game", "autoloads", "g") in facts and ("godot_input_action", "jump") in nodes


def test_nothing_breaks():
    for path in ("x.py", "x.go", "x.ts", "x.java", "x.swift", "x.gd", "x.tscn", "x.proto", "x.sql", "x.md", "x.json", "x.yaml", ".env", "go.mod", "x.bin"):
        for text in ("", "\0", "{", "}" * 50, "'\"`(" * 20, "a" * 10_000):
            parse_file("r", path, text)


FLOWS = {
    "a/box.go": "package a\n\ntype Base struct {\n\tID int\n}\n\ntype Box struct {\n\tBase\n\tW, H int\n}\n\nfunc (b *Box) Grow(by int, c ctx.C) int {\n\treturn Scale(by, 4)\n}\n\nfunc Scale(x, y int) int {\n\treturn x\n}\n",
    "a/box.ts": "export class Box {\n  private size: number = 3;\n  grow(by: string, y = 2) {\n    scale(by)\n  }\n}\n\nexport function scale(x: string) {\n  return x\n}\n",
    "a/Box.java": "public class Box {\n    private final int size = 3;\n    public int grow(int by, List<String> names) {\n        int local = 4;\n        return scale(by);\n    }\n}\n",
    "a/box.swift": "struct Box {\n    var size: Int = 3\n    func grow(by amount: Int) -> Int {\n        return scale(amount)\n    }\n}\n",
}


@pytest.mark.parametrize(("path", "fields", "parameters", "flows"), [
    ("a/box.go", {"Base.ID", "Box.W", "Box.H"}, {"Box.Grow.by", "Box.Grow.c", "Scale.x", "Scale.y"}, {("passes", "Box.Grow.by"), ("returns", "Box.Grow.by"), ("returns", "Scale.x"), ("embeds", "Box")}),
    ("a/box.ts", {"Box.size"}, {"Box.grow.by", "Box.grow.y", "scale.x"}, {("passes", "Box.grow.by"), ("returns", "scale.x")}),
    ("a/Box.java", {"Box.size"}, {"Box.grow.by", "Box.grow.names"}, {("passes", "Box.grow.by"), ("returns", "Box.grow.by")}),
    ("a/box.swift", {"Box.size"}, {"Box.grow.amount"}, {("passes", "Box.grow.amount"), ("returns", "Box.grow.amount")}),
])
def test_members_and_data_flow(path, fields, parameters, flows):
    found = parse_file("r", path, FLOWS[path])
    module = path.rsplit(".", 1)[0] + "."
    names = {n["id"]: n["qualified_name"].removeprefix(module) for n in found.nodes}
    of = lambda kind: {names[n["id"]] for n in found.nodes if n["kind"] == kind}
    assert of("field") == fields and of("parameter") == parameters
    assert {(f["kind"], names[f["from_id"]]) for f in found.facts if f["kind"] in ("passes", "returns", "embeds")} == flows
    assert len([f for f in found.facts if f["kind"] == "has_field"]) == len(fields)


def test_go_codecs():
    text = "package a\n\nfunc Send(order *pb.Order) []byte {\n\tdata, _ := proto.Marshal(order)\n\treturn data\n}\n\nfunc Read(data []byte) {\n\tvar got pb.Receipt\n\tproto.Unmarshal(data, &got)\n\tproto.Unmarshal(data, other)\n\tproto.Marshal(&pb.Ack{Ok: true})\n}\n"
    found = parse_file("r", "a/x.go", text)
    names = {n["id"]: n["qualified_name"] for n in found.nodes}
    got = {(names[f["from_id"]], f["kind"], f["target"], f["line"]) for f in found.facts if f["kind"] in ("encodes", "decodes")}
    assert got == {("a/x.Send", "encodes", "Order", 4), ("a/x.Read", "decodes", "Receipt", 10), ("a/x.Read", "encodes", "Ack", 12)}
    assert all(f["target_kind"] == "type" for f in found.facts if f["kind"] == "encodes")
