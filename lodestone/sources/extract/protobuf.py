"""Protocol Buffers definitions."""

from __future__ import annotations

import re

from .builder import Builder, Result

SUFFIXES = (".proto",)
SCALARS = frozenset("double float int32 int64 uint32 uint64 sint32 sint64 fixed32 fixed64 sfixed32 sfixed64 bool string bytes".split())
TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"])*\"|'(?:\\.|[^'])*'|[A-Za-z_][\w.]*|\.[A-Za-z_][\w.]*|\d[\w.]*|.", re.S)


class _Parser:
    def __init__(self, b: Builder, text: str):
        self.b, self.package, self.at = b, "", 0
        self.t: list[tuple[str, int]] = []
        line = 1
        for m in TOKEN.finditer(text):
            if not m[0].isspace() and not m[0].startswith(("//", "/*")):
                self.t.append((m[0], line))
            line += m[0].count("\n")

    def peek(self, ahead: int = 0) -> str:
        return self.t[self.at + ahead][0] if self.at + ahead < len(self.t) else ""

    @property
    def line(self) -> int:
        return self.t[min(self.at, len(self.t) - 1)][1] if self.t else 1

    def take(self) -> str:
        self.at += 1
        return self.t[self.at - 1][0] if self.at <= len(self.t) else ""

    def skip(self) -> str:
        """Past the statement or block that begins here; its text."""
        out, depth = [], 0
        while self.at < len(self.t):
            x = self.take()
            out.append(x)
            depth += (x in "{[(") - (x in "}])")
            if depth <= 0 and x in (";", "}"):
                break
        return " ".join(out)

    def qualified(self, outer: str, name: str) -> str:
        return f"{outer}.{name}" if outer else name

    def file(self) -> None:
        while self.at < len(self.t):
            word = self.peek()
            if word == "package":
                self.take()
                self.package = self.take()
                self.skip()
            elif word == "import":
                line = self.line
                self.take()
                while self.peek() in ("public", "weak"):
                    self.take()
                self.b.fact("imports", self.b.file, self.take().strip("\"'"), "file", line)
                self.skip()
            elif word in ("message", "enum", "service", "extend"):
                self.block(self.b.file, self.package)
            else:
                self.skip()

    def block(self, parent: str, outer: str) -> None:
        what, line = self.take(), self.line
        name = self.take()
        full = self.qualified(outer, name)
        if what == "extend":
            self.b.fact("references", self.b.file, name.lstrip("."), "type", line, role="extendee")
            key = self.b.file
        elif what == "service":
            key = self.b.declare(parent, "interface", name, full, line)
        else:
            key = self.b.declare(parent, "type", name, full, line, declaration=what)
        self.take()  # {
        if what == "enum":
            self.values(key, full)
        elif what == "service":
            self.methods(key, full)
        else:
            self.fields(key, full, "")

    def values(self, key: str, full: str) -> None:
        while self.at < len(self.t) and self.peek() != "}":
            name, line = self.peek(), self.line
            text = self.skip()
            if m := re.match(r"(\w+) = (-? ?\w+)", text):
                if name not in ("option", "reserved"):
                    f = self.b.node("field", name, f"{full}.{name}", line, number=m[2].replace(" ", ""))
                    self.b.fact("has_field", key, target_id=f, line=line)
        self.take()

    def methods(self, key: str, full: str) -> None:
        while self.at < len(self.t) and self.peek() != "}":
            line, text = self.line, self.skip()
            if m := re.match(r"rpc (\w+) \( (stream )?([\w.]+) \) returns \( (stream )?([\w.]+) \)", text):
                flag = lambda x: "true" if x else "false"
                rpc = self.b.declare(key, "method", m[1], f"{full}.{m[1]}", line, input=m[3], output=m[5], client_streaming=flag(m[2]), server_streaming=flag(m[4]))
                for role, name in (("input", m[3]), ("output", m[5])):
                    self.b.fact("references", rpc, name.lstrip("."), "type", line, role=role)
        self.take()

    def fields(self, key: str, full: str, oneof: str) -> None:
        while self.at < len(self.t) and self.peek() != "}":
            word, line = self.peek(), self.line
            if word in ("message", "enum") and self.peek(2) == "{":
                self.block(key, full)
            elif word == "oneof":
                self.take()
                name = self.take()
                self.take()
                self.fields(key, full, name)
            elif word in ("option", "reserved", "extensions", "extend", ";"):
                self.skip() if word != "extend" else self.block(key, full)
            else:
                self.field(key, full, oneof, line)
        self.take()

    def field(self, key: str, full: str, oneof: str, line: int) -> None:
        text = self.skip()
        m = re.match(r"(?:(optional|required|repeated) )?(map < (\S+) , (\S+) >|[\w.]+) (\w+) = (\w+)(.*)", text)
        if not m:
            return
        kind = "map" if m[3] else m[2]
        json_name = re.search(r"json_name = [\"'](\w+)[\"']", m[7])
        node = self.b.node(
            "field", m[5], f"{full}.{m[5]}", line, number=m[6], cardinality="map" if m[3] else m[1] or "singular", type=kind, oneof=oneof,
            json_name=json_name[1] if json_name else "", map_key=m[3] or "", map_value=m[4] or "",
        )
        self.b.fact("has_field", key, target_id=node, line=line)
        used, role = (m[4], "map_value") if m[3] else (m[2], "field_type")
        if used.lstrip(".") not in SCALARS:
            self.b.fact("references", node, used.lstrip("."), "type", line, role=role)


def parse(repository: str, path: str, text: str) -> Result:
    b = Builder(repository, path, "protobuf", text.count("\n") + 1)
    _Parser(b, text).file()
    return b.result()
