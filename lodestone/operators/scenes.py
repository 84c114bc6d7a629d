"""Paths of game resources as selectors.

A resource is called by its path without the extension. A ``res://`` or ``user://``
path is relative to the folder of its project file and must not leave it; a project is
not named in it, so it is tried against every project of the index."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a path's extension says, and the scheme prefixes.
CLASSES = {
    **dict.fromkeys((".tscn", ".escn", ".scn"), "godot_scene"),
    **dict.fromkeys((".gd", ".cs", ".gdshader", ".gdshaderinc"), "module"),
    **dict.fromkeys((".tres", ".res"), "godot_resource"),
}
SCHEMES = ("res://", "user://")
PROJECT_FILE = "project.godot"
MOST_PROJECTS = 256


def kind_of_path(path: str) -> str:
    """The node kind that the extension names; '' for any other."""
    return CLASSES.get(posixpath.splitext(path.strip())[1].lower(), "")


def identity(path: str) -> str:
    """A repository-relative path without its extension; a name that is all extension
    stays whole."""
    path = path.strip().replace("\\", "/").removeprefix("./")
    base = posixpath.basename(path)
    dot = base.rfind(".")
    return path[: len(path) - len(base) + dot] if dot > 0 else path


def resolved(project: str, reference: str) -> str:
    """The identity of a reference seen from the project in folder ``project``; '' for
    an alias without a path and for one that leaves its project or the repository."""
    reference = reference.strip().removeprefix("*").strip()
    scheme = next((s for s in SCHEMES if reference.startswith(s)), "")
    path = reference.removeprefix(scheme).replace("\\", "/").lstrip("/")
    if not path or reference.startswith("uid://"):
        return ""
    project = project.strip().strip("/")
    if scheme and project:
        full = posixpath.normpath(f"{project}/{path}")
        return identity(full) if full == project or full.startswith(f"{project}/") else ""
    full = posixpath.normpath(path)
    return "" if full in (".", "..") or full.startswith("../") else identity(full)


def resource_selectors(nodes: DataFrame, selectors: list[str], kind: str = "") -> list[str]:
    """The call's selectors; one that is a resource's path becomes the id of the only
    local node it means. Several raise, none leaves the selector as it is."""
    asked = {s: kind or kind_of_path(s) for s in selectors if s.strip().startswith(SCHEMES) or kind_of_path(s)}
    if not asked:
        return selectors
    local = nodes.where("not external")
    projects = [""]
    if any(s.strip().startswith(SCHEMES) for s in asked):
        files = local.where("kind = 'file'").where(F.lower("name") == PROJECT_FILE).select("path").distinct().limit(MOST_PROJECTS + 1).collect()
        if len(files) > MOST_PROJECTS:
            raise LookupError(f"over {MOST_PROJECTS} project files: name the resource by its path in the repository")
        projects = sorted({posixpath.dirname(r["path"]) for r in files}) or [""]
    means = {s: {i for p in (projects if s.strip().startswith(SCHEMES) else [""]) if (i := resolved(p, s))} for s in asked}
    names = sorted({i for ids in means.values() for i in ids})
    # A resource's qualified name is its path, with or without the extension.
    bare = F.regexp_replace("qualified_name", r"(?<=[^/])\.[^./]*$", "")
    found = local.where(F.col("kind").isin(*CLASSES.values())).where(bare.isin(*names)).select("id", "kind", bare.alias("name")).distinct().collect()
    out = []
    for s in selectors:
        hits = sorted({r["id"] for r in found if s in asked and r["name"] in means[s] and asked[s] in ("", r["kind"])})
        if len(hits) > 1:
            raise LookupError(f"ambiguous: {s!r} is the path of resources in several projects: {hits}")
        out.append(hits[0] if hits else s)
    return out
