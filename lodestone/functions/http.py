"""HTTP methods, routes and their compatibility.

A route is parsed once per distinct text into a *pattern*: a tuple of steps. A step
is ``("lit", text)``, ``("any",)``, ``("re", constraint)``, ``("rest",)`` or
``("end",)``. Compatibility asks whether what is known of a request proves that it
satisfies a declaration. Equality of plain routes is decided in SQL; only pairs with
a template reach Python, on distinct texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NONE, EXACT, TEMPLATE, CATCHALL = 0, 1, 2, 3
METHOD = r"^[!#$%&'*+.^_`|~0-9A-Za-z-]+$"


def method(c: Column) -> Column:
    """Trimmed and upper-cased; null if it is no method token."""
    t = F.trim(c)
    return F.when(t.rlike(METHOD), F.upper(t))


def preserved_method(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike(METHOD), t)


@dataclass(frozen=True)
class Route:
    path: str
    canonical: str
    query: str
    fragment: str
    scheme: str
    authority: str
    steps: tuple[tuple[str, ...], ...]
    slash: bool

    @property
    def plain(self) -> bool:
        return all(s[0] == "lit" for s in self.steps)

    @property
    def open(self) -> bool:
        """Whether the last step is a catch-all or a closing mark."""
        return bool(self.steps) and self.steps[-1][0] in ("rest", "end")

    @property
    def literal(self) -> str:
        """The steps of a plain route as one key."""
        return "\0".join(s[1] for s in self.steps) if self.plain else ""

    def lead(self, at: int) -> str:
        """What step ``at`` asks for: ``=text``, ``*`` (a template) or ``-`` (no step)."""
        head = self.steps[:-1] if self.open else self.steps
        return "-" if at >= len(head) else "=" + head[at][1] if head[at][0] == "lit" else "*"


class BadRoute(ValueError):
    pass


def _cut(text: str, mark: str) -> tuple[str, str]:
    """Split at the first ``mark`` outside braces."""
    depth, in_class, skip = 0, False, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif c == "\\" and depth:
            skip = True
        elif depth and c in "[]":
            in_class = c == "["
        elif not in_class and c in "{}":
            depth = max(0, depth + (1 if c == "{" else -1))
        elif c == mark and not depth:
            return text[:i], text[i + 1 :]
    return text, ""


def _unescaped(text: str) -> str:
    if re.search(r"%(?![0-9A-Fa-f]{2})", text):
        raise BadRoute(f"bad escape in {text!r}")
    return unquote(text)


def _step(part: str) -> tuple[tuple[str, ...], str]:
    if part.startswith("*"):
        return ("rest",), "{_...}"
    if not re.search(r"[{}]", part):
        if "\\" in part:
            raise BadRoute("a literal holds a backslash")
        return ("lit", _unescaped(part)), part
    if not (len(part) > 2 and part[0] == "{" and part[-1] == "}"):
        raise BadRoute(f"malformed segment {part!r}")
    name, colon, constraint = part[1:-1].partition(":")
    if part == "{$}":
        return ("end",), part
    if part.endswith("...}"):
        if part == "{...}":
            raise BadRoute("a catch-all without a name")
        return ("rest",), "{_...}"
    if not name or re.search(r"[{}/]", name) or (colon and not constraint):
        raise BadRoute(f"malformed parameter {part!r}")
    if not colon:
        return ("any",), "{_}"
    try:
        re.compile(constraint)
    except re.error as e:
        raise BadRoute(str(e)) from e
    return ("re", constraint), "{_:" + constraint + "}"


def parse_route(text: str) -> Route:
    raw = text.strip(" ")
    if not raw or re.search(r"[\r\n\t]", raw):
        raise BadRoute(f"{text!r} is empty or holds line breaks")
    core, fragment = _cut(raw, "#")
    core, query = _cut(core, "?")
    _unescaped(query), _unescaped(fragment)
    path, scheme, authority = core, "", ""
    if m := re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", core):
        parts = urlsplit(core)
        scheme, authority = m[1].lower(), parts.netloc.rpartition("@")[2]
        if scheme not in ("http", "https") or not authority:
            raise BadRoute(f"{text!r} is no http URL")
        path = parts.path or "/"
    elif not core.startswith("/") or core.startswith("//"):
        raise BadRoute(f"{text!r} is neither a path nor a URL")
    if any(_unescaped(p) in (".", "..") for p in path.split("/")):
        raise BadRoute(f"{text!r} holds a dot segment")
    slash = path != "/" and path.endswith("/")
    path = path.rstrip("/") or "/"
    read = [_step(p) for p in path[1:].split("/")] if path != "/" else []
    if any(s[0] in ("rest", "end") for s, _ in read[:-1]):
        raise BadRoute("a closing wildcard must come last")
    canonical = "/" + "/".join(c for _, c in read)
    return Route(path, canonical, query, fragment, scheme, authority, tuple(s for s, _ in read), slash)


@lru_cache(maxsize=100_000)
def route_or_none(text: str | None) -> Route | None:
    try:
        return parse_route(text or "")
    except ValueError:
        return None


def _proves(declared: tuple[str, ...], asked: tuple[str, ...]) -> bool:
    kind = declared[0]
    if kind == "any":
        return asked[0] != "rest"
    if kind == "re":
        return asked == declared or asked[0] == "lit" and re.fullmatch(declared[1], asked[1]) is not None
    return kind != "rest" and asked == declared


def compatibility(declared: Route, asked: Route) -> int:
    """Rank of the match; ``EXACT`` needs plain routes with the same closing slash."""
    if declared.plain and asked.plain and declared.slash == asked.slash and declared.steps == asked.steps:
        return EXACT
    head, tail = declared.steps, None
    if head and head[-1][0] in ("rest", "end"):
        head, tail = head[:-1], head[-1][0]
    if len(asked.steps) < len(head) or not all(map(_proves, head, asked.steps)):
        return NONE
    left = asked.steps[len(head) :]
    if tail == "rest":
        return CATCHALL if left or asked.slash else NONE
    if tail == "end":
        closes = left == (("end",),) if left else asked.slash
        return TEMPLATE if closes else NONE
    return NONE if left else TEMPLATE


def join_routes(prefix: str, leaf: str) -> Route:
    """A router prefix and a leaf path; query and fragment are the leaf's."""
    a, b = parse_route(prefix), parse_route(leaf)
    if a.authority or a.query or a.fragment or b.authority:
        raise BadRoute("only paths are joined")
    path = a.path if b.path == "/" else a.path.rstrip("/") + "/" + b.path.lstrip("/")
    return parse_route(path + (f"?{b.query}" if b.query else "") + (f"#{b.fragment}" if b.fragment else ""))


_TEXT, _FLAG = T.StringType(), T.BooleanType()
ROUTE_STRUCT = T.StructType(
    [T.StructField("valid", _FLAG)]
    + [T.StructField(n, _TEXT) for n in ("path", "canonical", "query", "fragment", "scheme", "authority")]
    + [T.StructField("plain", _FLAG), T.StructField("slash", _FLAG), T.StructField("open", _FLAG), T.StructField("steps", T.IntegerType())]
    + [T.StructField(n, _TEXT) for n in ("literal", "first", "second")]
)


@F.pandas_udf(ROUTE_STRUCT)
def route_info(texts: pd.Series) -> pd.DataFrame:
    """Parsed fields of a route text; ``valid`` is false for what is no route."""
    rows = []
    for t in texts:
        r = route_or_none(t)
        if r is None:
            rows.append((False, *[""] * 6, False, False, False, 0, "", "", ""))
        else:
            texts_ = (r.path, r.canonical, r.query, r.fragment, r.scheme, r.authority)
            rows.append((True, *texts_, r.plain, r.slash, r.open, len(r.steps), r.literal, r.lead(0), r.lead(1)))
    return pd.DataFrame(rows, columns=ROUTE_STRUCT.fieldNames())


@F.pandas_udf(T.IntegerType())
def route_rank(declared: pd.Series, asked: pd.Series) -> pd.Series:
    """Compatibility of two route texts; 0 also where one is no route."""
    out = []
    for d, a in zip(declared, asked, strict=True):
        x, y = route_or_none(d), route_or_none(a)
        out.append(NONE if x is None or y is None else compatibility(x, y))
    return pd.Series(out, dtype="int32")


# ---- destinations -------------------------------------------------------------

# Legal (authority, resolution, evidence) of a destination.
DESTINATIONS = (
    ("local", "", ""), ("external", "", ""), ("unknown", "", ""),
    ("local", "resolved", "exact_target"), ("unknown", "resolved", "exact_target"),
    ("local", "resolved", "route"), ("local", "resolved", "federated"),
    ("local", "ambiguous", "route"), ("local", "ambiguous", "federated"),
    ("local", "unresolved", "route"), ("unknown", "unresolved", "unknown_authority"),
    ("external", "external", "explicit_authority"),
)


def authority_state(explicit: Column, unknown: Column) -> Column:
    """external if an authority is named, unknown if it is marked so, else local;
    null (illegal) if it is both."""
    named = F.coalesce(F.trim(explicit), F.lit("")) != ""
    dark = F.trim(F.coalesce(unknown, F.lit(""))) == "true"
    return F.when(named & ~dark, "external").when(dark & ~named, "unknown").when(~named, "local")


def destination_is_legal(authority: Column, resolution: Column, evidence: Column) -> Column:
    known = ["|".join(d) for d in DESTINATIONS]
    return F.coalesce(F.concat_ws("|", authority, resolution, evidence).isin(*known), F.lit(False))


def target_is_legal(resolution: Column, external: Column) -> Column:
    """A resolved request ends at a local endpoint, any other at an external node."""
    return (resolution == "resolved") != external


def with_destination(properties: Column, resolution: Column | str, evidence: Column | str) -> Column:
    """The properties with the derived destination keys replaced."""
    keys = ("http_destination_resolution", "http_destination_evidence")
    own = F.map_filter(properties, lambda k, _: ~k.isin(*keys))
    r, e = (x if isinstance(x, Column) else F.lit(x) for x in (resolution, evidence))
    return F.map_concat(own, F.create_map(F.lit(keys[0]), r, F.lit(keys[1]), e))
