"""Configured call effects: what a project's own wrappers do.

``adapters`` in the configuration names symbols whose calls publish or subscribe to an
event, or send a request, and which argument plays which role. Validation is closed:
anything unknown raises before a file is read. Calls are found among the ``calls`` facts
that a frontend made, so imports and scopes are applied already; an argument counts only
if it is one string literal, since nothing else is known from the text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .extract.builder import Result

# The roles of each effect.
ROLES = {
    "event.publish": ("event",),
    "event.subscribe": ("event", "handler"),
    "event.unsubscribe": ("event", "handler"),
    "event.connection_test": ("event", "handler"),
    "http.request": ("method", "url"),
}
SYMBOL = re.compile(r"[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)+")
LANGUAGES = ("gdscript",)


@dataclass(frozen=True)
class Effect:
    kind: str
    arguments: tuple[tuple[str, int], ...]  # role, position


@dataclass(frozen=True)
class Adapter:
    language: str
    symbol: str
    effects: tuple[Effect, ...]


def _only(what: str, value: object, allowed: tuple[str, ...]) -> dict:
    if not isinstance(value, dict) or set(value) - set(allowed):
        raise ValueError(f"{what} has the fields {', '.join(allowed)}")
    return value


def _effect(item: object) -> Effect:
    fields = _only("an adapter effect", item, ("kind", "roles"))
    kind = str(fields.get("kind", "")).strip()
    if kind not in ROLES:
        raise ValueError(f"unsupported adapter effect {kind!r}")
    roles = _only(f"adapter effect {kind!r}", fields.get("roles"), ROLES[kind])
    if missing := set(ROLES[kind]) - set(roles):
        raise ValueError(f"adapter effect {kind!r} needs the roles {sorted(missing)}")
    places = {}
    for role, selector in roles.items():
        place = _only(f"role {role!r}", selector, ("argument",)).get("argument")
        if isinstance(place, bool) or not isinstance(place, int) or place < 0 or place in places.values():
            raise ValueError(f"role {role!r} takes one argument of its own, counted from 0")
        places[role] = place
    return Effect(kind, tuple(sorted(places.items())))


def load_adapters(items: object) -> list[Adapter]:
    """The configured adapters, by language and symbol; what is malformed raises."""
    if not isinstance(items, list):
        raise ValueError("adapters are a list")
    found: dict[tuple[str, str], Adapter] = {}
    for item in items:
        fields = _only("an adapter", item, ("match", "effects"))
        match = _only("an adapter's match", fields.get("match"), ("language", "symbol"))
        language, symbol = str(match.get("language", "")).strip().lower(), str(match.get("symbol", "")).strip()
        if language not in LANGUAGES:
            raise ValueError(f"unsupported adapter language {language!r}")
        if not SYMBOL.fullmatch(symbol):
            raise ValueError(f"adapter symbol {symbol!r} is no qualified symbol")
        if (language, symbol) in found:
            raise ValueError(f"adapter symbol {symbol!r} is declared twice")
        if not isinstance(fields.get("effects"), list) or not fields["effects"]:
            raise ValueError("an adapter's effects are a list that is not empty")
        effects = sorted((_effect(e) for e in fields["effects"]), key=lambda e: e.kind)
        if len({e.kind for e in effects}) < len(effects):
            raise ValueError(f"adapter {symbol!r} has an effect twice")
        found[language, symbol] = Adapter(language, symbol, tuple(effects))
    return [found[k] for k in sorted(found)]


def arguments(text: str, at: int) -> list[str] | None:
    """The arguments of the call whose bracket opens at ``at``; None if it never ends."""
    out, depth, start, i = [], 0, at + 1, at
    while i < len(text):
        c = text[i]
        if c in "\"'":
            end = re.compile(rf"(?:\\.|[^\\{c}])*{c}", re.S).match(text, i + 1)
            if not end:
                return None
            i = end.end()
            continue
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                last = text[start:i].strip()
                return [*out, last] if last or out else []
        elif c == "," and depth == 1:
            out.append(text[start:i].strip())
            start = i + 1
        i += 1
    return None


def _literal(argument: str) -> str:
    m = re.fullmatch(r"&?([\"'])((?:\\.|[^\\])*?)\1", argument)
    return m[2] if m else ""


def apply(adapters: list[Adapter], language: str, text: str, found: Result) -> Result:
    """``found`` with the facts that the adapters add for its file's calls."""
    by_symbol = {a.symbol: a for a in adapters if a.language == language}
    if not by_symbol:
        return found
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    added: dict[str, dict] = {}
    for fact in found.facts:
        adapter = by_symbol.get(fact["target"]) if fact["kind"] == "calls" else None
        if adapter is None:
            continue
        tail = adapter.symbol.rsplit(".", 1)[-1]
        begin, end = starts[fact["line"] - 1], starts[fact["line"]]
        for m in re.compile(rf"\b{tail}\(").finditer(text, begin, end):
            given = arguments(text, m.end() - 1)
            for effect in adapter.effects if given is not None else ():
                place = dict(effect.arguments)
                value = {r: _literal(given[i]) if i < len(given) else "" for r, i in place.items()}
                kind, target, target_kind = "", value.get("event", ""), "event"
                if effect.kind == "event.publish":
                    kind = "publishes"
                elif effect.kind == "event.subscribe":
                    kind = "subscribes"
                elif effect.kind == "http.request" and value["method"] and value["url"]:
                    kind, target, target_kind = "requests", f"{value['method'].upper()} {value['url']}", "endpoint"
                if not kind or not target:
                    continue
                more = {"adapter_source": effect.kind, "adapter_symbol": adapter.symbol}
                if effect.kind == "event.subscribe" and place["handler"] < len(given):
                    more["handler"] = given[place["handler"]]
                from ..functions.ids import py_stable_id

                key = py_stable_id("f", fact["path"], fact["from_id"], kind, target, fact["line"], m.start())
                added[key] = {**fact, "id": key, "kind": kind, "target_id": "", "target": target, "target_kind": target_kind, "properties": more}
    return Result(found.nodes, sorted([*found.facts, *added.values()], key=lambda f: f["id"]), found.diagnostics)
