"""Game scenes, resources, project settings and identity sidecars (text formats of
``[section key=value]`` headers followed by assignments)."""

from __future__ import annotations

import posixpath
import re

from .builder import Builder, Result

SUFFIXES = (".tscn", ".tres", ".escn", ".uid", "project.godot")
HEADER = re.compile(r"^\[(\w+)((?:\s+\w+=(?:\"(?:\\.|[^\"])*\"|\w+\([^)]*\)|\[[^\]]*\]|[^\s\]]+))*)\s*\]$")
ATTRIBUTE = re.compile(r"(\w+)=(\"(?:\\.|[^\"])*\"|\w+\([^)]*\)|\[[^\]]*\]|[^\s\]]+)")
EXTERNAL = re.compile(r"ExtResource\(\s*\"?([\w-]+)\"?\s*\)")
SCRIPTS, SCENES = (".gd", ".cs"), (".tscn", ".escn")


def resource_name(path: str) -> str:
    """``res://`` path -> project path; '' if it leaves the project."""
    full = posixpath.normpath(path.removeprefix("res://"))
    return "" if full.startswith((".", "/")) else full


def kind_of(path: str) -> str:
    return "godot_scene" if path.endswith(SCENES) else "module" if path.endswith(SCRIPTS) else "godot_resource"


def name_of(path: str) -> str:
    """The qualified name that a project path declares: scripts without suffix."""
    return path.rsplit(".", 1)[0] if path.endswith(SCRIPTS) else path


def _sections(text: str):
    """(line, name, attributes, assignments) of each section."""
    current = (1, "", {}, {})
    for n, raw in enumerate(text.split("\n"), 1):
        line = raw.strip()
        if m := HEADER.match(line):
            yield current
            current = (n, m[1], {k: v.strip('"') for k, v in ATTRIBUTE.findall(m[2])}, {})
        elif line and not line.startswith(";") and "=" in line and (k := re.match(r"([\w/.:-]+)\s*=\s*(.*)", line)):
            current[3][k[1]] = (k[2], n)
    yield current


def parse_scene(repository: str, path: str, text: str) -> Result:
    b = Builder(repository, path, "godot", text.count("\n") + 1)
    kind = kind_of(path)
    root = b.declare(b.file, kind, path.rsplit("/", 1)[-1], path, 1, text.count("\n") + 1)
    outside: dict[str, str] = {}
    nodes: dict[str, str] = {}
    for n, section, attributes, body in _sections(text):
        if section == "ext_resource" and (target := resource_name(attributes.get("path", ""))):
            outside[attributes.get("id", "")] = target
            b.fact("imports", root, name_of(target), kind_of(target), n, uid=attributes.get("uid", ""))
        elif section == "node" and "name" in attributes:
            parent = attributes.get("parent")
            place = attributes["name"] if parent in (None, ".") else f"{parent}/{attributes['name']}"
            place = "." if parent is None else place
            key = b.node("godot_scene_node", attributes["name"], f"{path}::{place}", n, scene=path, type=attributes.get("type", ""))
            b.fact("contains", root if parent is None else nodes.get(parent, root), target_id=key, line=n)
            nodes[place] = key
            if m := EXTERNAL.search(attributes.get("instance", "")):
                if target := outside.get(m[1]):
                    b.fact("instantiates", key, target, "godot_scene", n)
            for group in re.findall(r"\"([^\"]+)\"", attributes.get("groups", "")):
                b.fact("in_group", key, group, "godot_node_group", n)
            for name, (value, at) in body.items():
                if m := EXTERNAL.search(value):
                    if target := outside.get(m[1]):
                        if name == "script":
                            b.fact("attaches_script", key, name_of(target), "module", at)
                        else:
                            b.fact("references", key, target, kind_of(target), at, property=name)
        elif section == "connection":
            source, goal = nodes.get(attributes.get("from", "")), nodes.get(attributes.get("to", ""))
            if source and goal:
                signal, method = attributes.get("signal", ""), attributes.get("method", "")
                b.fact("subscribes", goal, signal, "event", n, form="signal_connection", **{"from": attributes.get("from", "")})
                b.fact("handled_by", source, method, "method", n, signal=signal)
        elif section == "resource":
            for name, (value, at) in body.items():
                if m := EXTERNAL.search(value):
                    if target := outside.get(m[1]):
                        b.fact("references", root, name_of(target), kind_of(target), at, property=name)
    return b.result()


def parse_project(repository: str, path: str, text: str) -> Result:
    b = Builder(repository, path, "godot", text.count("\n") + 1)
    for _, section, _, body in _sections(text.replace("\r", "")):
        for key, (value, n) in body.items():
            full = f"{section}/{key}" if section else key
            node = b.node("config_key", full, f"config:{path}:{full}", n, defined="true", format="project", section=section)
            b.fact("defines", b.file, target_id=node, line=n)
            target = resource_name(value.strip('"*')) if "res://" in value else ""
            if section == "autoload" and target:
                auto = b.declare(b.file, "godot_autoload", key, f"autoload:{key}", n, singleton="true" if value.startswith('"*') else "")
                b.fact("autoloads", auto, name_of(target), kind_of(target), n)
            elif section == "input":
                action = b.node("godot_input_action", key, key, n)
                b.fact("defines", b.file, target_id=action, line=n)
            elif section == "global_group":
                group = b.node("godot_node_group", key, key, n)
                b.fact("defines", b.file, target_id=group, line=n)
            elif target:
                b.fact("references", node, name_of(target), kind_of(target), n)
    return b.result()


def parse_uid(repository: str, path: str, text: str) -> Result:
    b = Builder(repository, path, "godot", 1)
    owner = path.removesuffix(".uid")
    if re.fullmatch(r"uid://[a-z0-9]+", text.strip()):
        b.fact("references", b.file, f"{repository}:{owner}", "file", 1, uid=text.strip())
    else:
        b.problem(1, "error", "not a uid")
    return b.result()
