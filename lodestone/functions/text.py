"""Name and text functions as columns, with Python twins where a driver needs
them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def simple_name(c: Column) -> Column:
    """The trimmed text after its last ``.``, ``:`` or ``/``."""
    return F.regexp_extract(F.trim(c), r"([^.:/]*)$", 1)


def fold_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fold(c: Column) -> Column:
    return F.lower(c)


def like_contains(c: Column, term: str) -> Column:
    """``LIKE '%term%'`` where ``%`` and ``_`` in the term stay live."""
    return c.like("%" + term.replace("\\", "\\\\") + "%")


def extends_name(child: Column, parent: Column) -> Column:
    """``child`` goes on after ``parent`` with a separator: the next character is
    no letter, digit or underscore."""
    rest = F.substr(child, F.char_length(parent) + 1)
    return (F.char_length(parent) > 0) & child.startswith(parent) & rest.rlike(r"^[^\p{L}\p{Nd}_]")


def module_name(path: Column) -> Column:
    """A path without its extension and a closing ``/index``."""
    return F.regexp_replace(F.regexp_replace(path, r"\.[^./]*$", ""), r"/index$", "")


def unquote(c: Column) -> Column:
    return F.regexp_replace(c, r"^(['\"`])(.*)\1$", "$2")


def split_identifier(c: Column) -> Column:
    """Words of an identifier: cut at camel-case steps and separators."""
    spaced = F.regexp_replace(c, r"(\p{Ll}|\p{Nd})(\p{Lu})", "$1 $2")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, r"[./:_\-()\[\]{},]+", " "), r"\s+", " "))


def properties_text(c: Column) -> Column:
    """A property map as JSON with sorted keys."""
    keys = F.array_sort(F.map_keys(c))
    return F.to_json(F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(c, k)))))


def parse_properties(c: Column) -> Column:
    """JSON text to a property map; text that is no string map is kept under
    ``_invalid``."""
    parsed = F.from_json(c, "map<string,string>")
    return F.when(F.coalesce(c, F.lit("")) == "", F.create_map().cast("map<string,string>")).otherwise(
        F.coalesce(parsed, F.create_map(F.lit("_invalid"), c))
    )


def match_rank(name: Column, qualified: Column, term: str) -> Column:
    """0 equal qualified name, 1 equal name, 2 name prefix, 3 qualified prefix, 4."""
    n, q, t = F.lower(name), F.lower(qualified), term.lower()
    return F.when(q == t, 0).when(n == t, 1).when(n.startswith(t), 2).when(q.startswith(t), 3).otherwise(4)


# ---- paths --------------------------------------------------------------------


def checked_prefix(prefix: str) -> str:
    """A project path prefix without closing slashes; raises on what cannot be one."""
    text = prefix.strip()
    while text.startswith("./"):
        text = text[2:]
    text = text.rstrip("/")
    if not text or text.startswith("/") or "\\" in text or re.match(r"[A-Za-z]:", text):
        raise ValueError(f"{prefix!r} is no project path prefix")
    if any(c in text for c in "*?[]{}") or ".." in text.split("/"):
        raise ValueError(f"{prefix!r} is a pattern or leaves the project")
    return text


def under_prefix(path: Column, prefixes: list[str]) -> Column:
    """The path is one of the prefixes or lies below one; no prefixes: always."""
    if not prefixes:
        return F.lit(True)
    tests = [(path == p) | path.startswith(p + "/") for p in map(checked_prefix, prefixes)]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def glob_regex(glob: str) -> str:
    """``**`` spans whole segments, ``*`` and ``?`` stay in one."""
    parts = glob.strip("/").split("/")
    out = ""
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
            continue
        out += "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in part)
        out += "" if last else ("/" if parts[i + 1] != "**" or i + 2 < len(parts) else "(?:/|$)")
    return f"^{out}$"


def in_scope(path: Column, include: list[str], exclude: list[str]) -> Column:
    """No include globs means all; exclude globs win."""
    inside = F.lit(True) if not include else F.lit(False)
    for g in include:
        inside = inside | path.rlike(glob_regex(g))
    for g in exclude:
        inside = inside & ~path.rlike(glob_regex(g))
    return inside


def glob_specificity(glob: str) -> tuple[int, int, str]:
    """Sort key: more literal characters first, then fewer wildcards, then text."""
    wild = sum(glob.count(c) for c in "*?")
    return -(len(glob) - wild), wild, glob
