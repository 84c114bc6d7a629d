"""What every frontend builds with: nodes and facts of one file, without repeats."""

from __future__ import annotations

from dataclasses import dataclass, field

from ...functions.ids import py_stable_id
from ...vocab import EDGE_KINDS, NODE_KINDS


@dataclass
class Result:
    nodes: list[dict] = field(default_factory=list)
    facts: list[dict] = field(default_factory=list)
    diagnostics: list[dict] = field(default_factory=list)


class Builder:
    """Collects one file's evidence. ``language`` is the producer of its facts."""

    def __init__(self, repository: str, path: str, language: str, lines: int = 1):
        self.repository, self.path, self.language = repository, path, language
        self._nodes: dict[str, dict] = {}
        self._facts: dict[str, dict] = {}
        self._diagnostics: list[dict] = []
        self.file = self.node("file", path.rsplit("/", 1)[-1], f"{repository}:{path}", 1, lines)

    def node(self, kind: str, name: str, qualified: str, line: int, end_line: int = 0, column: int = 1, language: str = "", **properties: str) -> str:
        if kind not in NODE_KINDS:
            raise ValueError(kind)
        more = () if kind == "file" else (self.repository, self.path)
        key = py_stable_id("n", kind, qualified, *more)
        self._nodes.setdefault(key, {
            "repository": self.repository, "id": key, "kind": kind, "name": name, "qualified_name": qualified,
            "language": language or self.language, "path": self.path, "line": line, "column_no": column, "end_line": max(end_line, line),
            "properties": {k: v for k, v in properties.items() if v != ""}, "owner_file": self.path, "external": False,
        })
        return key

    def fact(self, kind: str, source: str, target: str = "", target_kind: str = "", line: int = 1, target_id: str = "", source_name: str = "", source_kind: str = "", **properties: str) -> str:
        """``source`` is an id, or '' with ``source_name``; likewise the target."""
        if kind not in EDGE_KINDS:
            raise ValueError(kind)
        key = py_stable_id("f", self.path, source or source_name, kind, target_id or target, line, len(self._facts))
        self._facts[key] = {
            "repository": self.repository, "id": key, "from_id": source, "source": "" if source else source_name, "source_kind": source_kind,
            "kind": kind, "producer": self.language, "target_id": target_id, "target": "" if target_id else target, "target_kind": target_kind,
            "path": self.path, "line": line, "column_no": 1, "end_line": line, "properties": {k: v for k, v in properties.items() if v != ""}, "owner_file": self.path,
        }
        return key

    def declare(self, parent: str, kind: str, name: str, qualified: str, line: int, end_line: int = 0, **properties: str) -> str:
        key = self.node(kind, name, qualified, line, end_line, **properties)
        self.fact("declares", parent, target_id=key, line=line)
        return key

    def endpoint(self, method: str, route: str, line: int) -> str:
        label = f"{method} {route}"
        return self.node("endpoint", label, f"endpoint:{label}@{self.path}:{line}", line, method=method, route=route)

    def problem(self, line: int, level: str, message: str) -> None:
        self._diagnostics.append({"repository": self.repository, "path": self.path, "line": line, "level": level, "message": message})

    def result(self) -> Result:
        by_id = lambda d: sorted(d.values(), key=lambda r: r["id"])
        return Result(by_id(self._nodes), by_id(self._facts), self._diagnostics)
