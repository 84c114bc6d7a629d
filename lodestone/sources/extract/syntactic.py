"""Frontends that read declarations and calls by patterns over comment-free text:
Go, TypeScript, Java, Swift, GDScript and shaders. They know no types: a call is the
name as written, with the file's imports applied, and resolution decides whether it
is unique."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .builder import Builder, Result

VERB = r"(get|post|put|patch|delete|head|options)"
LITERAL = r"[\"'`]([^\"'`$\\]+)[\"'`]"


@dataclass(frozen=True)
class Language:
    name: str
    suffixes: tuple[str, ...]
    comment: str  # a line comment's start
    declare: tuple[tuple[str, str], ...]  # kind, pattern with the group n
    imports: str  # pattern with the group m, perhaps a (alias)
    inherit: tuple[tuple[str, str], ...] = ()  # edge kind, pattern with n and b
    config: str = ""  # pattern with the group k
    indent_blocks: bool = False
    member: str = ""  # a field's pattern with n, inside a class or type
    keywords: frozenset[str] = field(default=frozenset("if for while switch return catch func function new super this self print match elif assert not await yield typeof sizeof defer go select".split()))


LANGUAGES = (
    Language(
        "go", (".go",), "//",
        (("test", r"^func (?P<n>Test\w+)\("), ("method", r"^func \((?:\w+ )?\*?(?P<o>\w+)(?:\[[^\]]*\])?\) (?P<n>\w+)"), ("function", r"^func (?P<n>\w+)"), ("interface", r"^type (?P<n>\w+) interface\b"), ("type", r"^type (?P<n>\w+)")),
        r"^(?:import\s+|\t)(?:(?P<a>[\w.]+) )?\"(?P<m>[\w./@-]+)\"$", config=r"os\.(?:Getenv|LookupEnv)\(\"(?P<k>[^\"]+)\"\)",
        member=r"^\t(?P<n>[A-Za-z_]\w*(?:, [A-Za-z_]\w*)*)\s+(?P<t>[\w\[\]*.]+(?:\{\})?)\s*(?:`.*)?$|^\t\*?(?:\w+\.)?(?P<e>[A-Z]\w*)\s*(?:`.*)?$",
    ),
    Language(
        "typescript", (".ts", ".tsx"), "//",
        (("class", r"^\s*(?:export )?(?:default )?(?:abstract )?class (?P<n>\w+)"), ("interface", r"^\s*(?:export )?interface (?P<n>\w+)"), ("type", r"^\s*(?:export )?type (?P<n>\w+)\b[^=]*="),
         ("function", r"^\s*(?:export )?(?:default )?(?:async )?function\*? (?P<n>\w+)"), ("function", r"^\s*(?:export )?const (?P<n>\w+)[^=]*=\s*(?:async )?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"),
         ("method", r"^\s+(?:public |private |protected |static |async |readonly )*(?P<n>(?!if\b|for\b|while\b|switch\b|return\b|catch\b|constructor\b)\w+)\([^;]*\)\s*(?::[^={]+)?\{")),
        r"^\s*(?:import|export)\b[^'\"]*from ['\"](?P<m>[^'\"]+)['\"]", (("extends", r"class (?P<n>\w+)[^{]*? extends (?P<b>[\w.]+)"), ("implements", r"class (?P<n>\w+)[^{]*? implements (?P<b>[\w.]+)")), r"process\.env\.(?P<k>\w+)",
        member=r"^\s+(?:public |private |protected |readonly |static )*(?P<n>\w+)[?!]?\s*:\s*(?P<t>[^=(;]+?)\s*(?:=.*)?[;,]?$",
    ),
    Language(
        "java", (".java",), "//",
        (("interface", r"^\s*(?:public |private |protected |static |abstract )*interface (?P<n>\w+)"), ("class", r"^\s*(?:public |private |protected |static |final |abstract )*(?:class|enum|record) (?P<n>\w+)"),
         ("method", r"^\s+(?:public |private |protected |static |final |synchronized |abstract )*(?:<[^>]+> )?[\w<>\[\], .?]+ (?P<n>(?!if\b|for\b|while\b|switch\b|return\b|catch\b|new\b)\w+)\([^;{=]*\)\s*(?:throws [\w, .]+)?\{")),
        r"^import (?:static )?(?P<m>[\w.]+)", (("extends", r"class (?P<n>\w+)[^{]*? extends (?P<b>[\w.]+)"), ("implements", r"class (?P<n>\w+)[^{]*? implements (?P<b>[\w.]+)")), r"System\.getenv\(\"(?P<k>[^\"]+)\"\)",
        member=r"^\s+(?:(?:public|private|protected|static|final|volatile|transient) )*(?!return\b|throw\b|package\b|import\b)(?P<t>[\w<>\[\], .?]+) (?P<n>\w+)\s*(?:=.*)?;\s*$",
    ),
    Language(
        "swift", (".swift",), "//",
        (("class", r"^\s*(?:public |open |final |private |internal )*(?:class|struct|enum|actor) (?P<n>\w+)"), ("interface", r"^\s*(?:public )?protocol (?P<n>\w+)"), ("function", r"^\s*(?:@\w+ )*(?:public |private |internal |static |override |open |mutating )*func (?P<n>\w+)")),
        r"^import (?P<m>\w+)", (("extends", r"(?:class|struct|protocol) (?P<n>\w+)\s*:\s*(?P<b>\w+)"),), r"environment\[\"(?P<k>[^\"]+)\"\]",
        member=r"^\s+(?:@\w+ )*(?:(?:public|private|internal|static|weak) )*(?:var|let) (?P<n>\w+)\s*(?::\s*(?P<t>[\w\[\]:?<>., ]+?))?\s*(?:=.*|\{.*)?$",
    ),
    Language(
        "gdscript", (".gd",), "#",
        (("class", r"^class_name (?P<n>\w+)"), ("class", r"^class (?P<n>\w+)"), ("event", r"^signal (?P<n>\w+)"), ("test", r"^func (?P<n>test_\w+)"), ("method", r"^(?:static )?func (?P<n>\w+)"), ("field", r"^(?:@\w+(?:\([^)]*\))? )*var (?P<n>\w+)")),
        r"(?:preload|load)\(\"(?P<m>res://[^\"]+)\"\)", (("extends", r"^(?P<n>)extends (?P<b>[\w\".:/]+)"),), r"ProjectSettings\.get_setting\(\"(?P<k>[^\"]+)\"", True,
    ),
    Language(
        "shader", (".gdshader", ".gdshaderinc"), "//",
        (("type", r"^struct (?P<n>\w+)"), ("field", r"^(?:global |instance )?(?:uniform|varying) \w+ (?P<n>\w+)"), ("function", r"^\w+ (?P<n>\w+)\([^;]*\)\s*\{")),
        r"#include \"(?P<m>[^\"]+)\"",
    ),
)


def without_comments(text: str, mark: str) -> str:
    """Comments become spaces; line breaks and strings stay."""
    block = r"|/\*.*?\*/" if mark == "//" else ""
    pattern = re.compile(rf"(\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`)|{re.escape(mark)}[^\n]*{block}", re.S)
    return pattern.sub(lambda m: m[1] if m[1] else re.sub(r"[^\n]", " ", m[0]), text)


def _pieces(text: str) -> list[str]:
    """Split at commas outside brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth <= 0:
            out.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*out, text[start:]] if p.strip()]


def _bracketed(lines: list[str], row: int, column: int) -> str:
    """What stands in the round brackets that open at or after the place."""
    text = "\n".join([lines[row][column:], *lines[row + 1 : row + 8]])
    first, depth = text.find("("), 0
    if first < 0 or text[:first].strip(" \t\n<>[]abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_,:=."):
        return ""
    for i in range(first, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if not depth:
            return text[first + 1 : i]
    return ""


def parameter_names(language: str, text: str) -> list[str]:
    pieces = _pieces(text)
    if language == "go":  # one named parameter names them all
        named = any(re.match(r"\w+\s+\S", p) for p in pieces)
        return [m[0] for p in pieces if (m := re.match(r"\w+", p)) and m[0] != "_"] if named else []
    pattern = {"java": r"(\w+)(?:\[\])*$", "swift": r"(\w+)\s*:", "shader": r"(\w+)$"}.get(language, r"(?:(?:public|private|protected|readonly) )*(?:\.\.\.)?(\w+)")
    find = re.match if language in ("typescript", "gdscript") else re.search
    return [m[1] for p in pieces if (m := find(pattern, p)) and m[1] != "_"]


def _end_line(lines: list[str], start: int, by_indent: bool) -> int:
    """The last line of the block that opens at ``start`` (from 0)."""
    if by_indent:
        end = start
        for i in range(start + 1, len(lines)):
            if lines[i].strip():
                if not lines[i][0].isspace():
                    break
                end = i
        return end + 1
    depth = opened = 0
    for i in range(start, len(lines)):
        line = re.sub(r"\"(?:\\.|[^\"])*\"|'(?:\\.|[^'])*'", "", lines[i])
        depth += line.count("{") - line.count("}")
        opened += line.count("{")
        if opened and depth <= 0:
            return i + 1
        if not opened and i > start + 3:
            return start + 1
    return len(lines) if opened else start + 1


def parse(language: Language, repository: str, path: str, text: str) -> Result:
    b = Builder(repository, path, language.name, text.count("\n") + 1)
    module = re.sub(r"(?:/index)?$", "", path.rsplit(".", 1)[0])
    b.node("module", module.rsplit("/", 1)[-1], module, 1)
    clean = without_comments(text, language.comment)
    lines = clean.split("\n")
    imports: dict[str, str] = {}
    scopes: list[tuple[int, int, str, str, str]] = []  # first, last, id, qualified name, kind
    declared: dict[str, str] = {}
    parameters: dict[str, dict[str, str]] = {}  # function id -> name -> id
    for n, line in enumerate(lines, 1):
        for m in re.finditer(language.imports, line):
            target = m["m"]
            alias = (m.groupdict().get("a") or target.rsplit("/", 1)[-1].rsplit(".", 1)[-1]).strip("_")
            imports[alias] = target
            b.fact("imports", b.file, target, "module", n, alias=m.groupdict().get("a") or "")
        for kind, pattern in language.declare:
            m = re.search(pattern, line)
            if not m:
                continue
            inside = next((s for s in reversed(scopes) if s[0] < n <= s[1] and s[4] in ("class", "interface", "type")), None)
            holder = m.groupdict().get("o") or ""
            parent_id, parent = (inside[2], inside[3]) if inside else (declared.get(holder, b.file), f"{module}.{holder}" if holder else module)
            if kind == "function" and inside:
                kind = "method"
            last = _end_line(lines, n - 1, language.indent_blocks)
            qualified = f"{parent}.{m['n']}"
            if kind == "field":
                key = b.node("field", m["n"], qualified, n)
                b.fact("has_field", parent_id, target_id=key, line=n)
            else:
                key = b.declare(parent_id, kind, m["n"], qualified, n, last)
            if kind in ("function", "method", "test"):
                names = parameter_names(language.name, _bracketed(lines, n - 1, m.end("n")))
                parameters[key] = {p: b.declare(key, "parameter", p, f"{qualified}.{p}", n) for p in names}
            declared[m["n"]] = key
            scopes.append((n, last, key, qualified, kind))
            break
        else:
            holder = next((s for s in reversed(scopes) if s[0] < n <= s[1]), None)
            if language.member and holder and holder[4] in ("class", "interface", "type") and (m := re.search(language.member, line)):
                for name in (m["n"] or "").split(", ") if m["n"] else ():
                    field_id = b.node("field", name, f"{holder[3]}.{name}", n, type=(m["t"] or "").strip())
                    b.fact("has_field", holder[2], target_id=field_id, line=n)
                if m.groupdict().get("e"):
                    b.fact("embeds", holder[2], m["e"], "", n)
        for edge, pattern in language.inherit:
            if m := re.search(pattern, line):
                source = declared.get(m["n"]) or (scopes[0][2] if scopes and scopes[0][4] == "class" else b.file)
                b.fact(edge, source, m["b"].strip('"'), "" if "/" in m["b"] else ("interface" if edge == "implements" else "class"), n)
    calls = re.compile(r"(?<![\w.])((?:\w+\.)*\w+)\(")
    variables: dict[str, dict[str, str]] = {}  # function id -> name -> type, as far as it is written
    for n, line in enumerate(lines, 1):
        owner = next((s for s in reversed(scopes) if s[0] <= n <= s[1] and s[4] in ("function", "method", "test")), None)
        source = owner[2] if owner else b.file
        if language.config:
            for m in re.finditer(language.config, line):
                b.fact("reads_config", source, m["k"], "config_key", n)
        for m in re.finditer(rf"(?i)(\w+)\.{VERB}\(\s*{LITERAL}(.*)", line):
            client, verb, route, rest = m.groups()
            if client in ("axios", "http", "client", "fetcher") and not re.match(r"\s*,\s*\w+\s*\)", rest):
                b.fact("requests", source, f"{verb.upper()} {route}", "endpoint", n)
            elif route.startswith("/") and (h := re.match(r"\s*,.*?([\w.]+)\s*\)\s*;?\s*$", rest)):
                e = b.endpoint(verb.upper(), route, n)
                b.fact("exposes", b.file, target_id=e, line=n)
                b.fact("handled_by", e, h[1], line=n, handler=h[1])
        if m := re.search(rf"\bfetch\(\s*{LITERAL}(?:.*?method:\s*[\"'](\w+))?", line):
            b.fact("requests", source, f"{(m[2] or 'GET').upper()} {m[1]}", "endpoint", n)
        if m := re.search(rf"\.HandleFunc\(\s*\"(?:(\w+) )?(/[^\"]*)\"\s*,\s*([\w.]+)", line):
            e = b.endpoint(m[1] or "ANY", m[2], n)
            b.fact("exposes", b.file, target_id=e, line=n)
            b.fact("handled_by", e, m[3], line=n, handler=m[3])
        for m in re.finditer(rf"\b(?:\w+\.)*(publish|emit|produce|emit_signal)\(\s*{LITERAL}", line):
            b.fact("publishes", source, m[2], "event", n)
        for m in re.finditer(rf"\b(?:\w+\.)+(subscribe|on|consume)\(\s*{LITERAL}", line):
            b.fact("subscribes", source, m[2], "event", n)
        if language.name == "go":
            _go_failures(b, source, line, n)
            _go_codecs(b, source, lines, n, variables.setdefault(source, {}))
        if owner:
            for m in calls.finditer(line):
                name = m[1]
                if name.split(".")[-1] in language.keywords or (owner[0] == n and name == owner[3].rsplit(".", 1)[-1]) or re.search(r"\b(?:func|function)\s+$", line[: m.start()]):
                    continue
                head, _, rest = name.partition(".")
                target = f"{imports[head]}.{rest}" if rest and head in imports else f"{module}.{name}" if name in declared and not rest else name
                b.fact("calls", source, target, line=n)
                for i, given in enumerate(_pieces(_bracketed(lines, n - 1, m.end() - 1))):
                    if given in parameters.get(source, {}):
                        b.fact("passes", parameters[source][given], target, line=n, argument=str(i))
            if m := re.match(r"\s*return\b(.*)", line):
                for name, key in parameters.get(source, {}).items():
                    if re.search(rf"\b{re.escape(name)}\b", m[1]):
                        b.fact("returns", key, target_id=source, line=n)
    return b.result()


def _go_failures(b: Builder, source: str, line: str, n: int) -> None:
    if m := re.search(r"\bpanic\((.*)\)", line):
        b.fact("panics", source, m[1].strip()[:120] or "panic", "type", n)
    if "recover()" in line:
        b.fact("recovers", source, "recover", "type", n)
    if m := re.match(r"\s*defer ([\w.]+)\(", line):
        b.fact("defers", source, m[1], line=n)
    if m := re.search(r"errors\.(?:Is|As)\(\s*\w+\s*,\s*&?([\w.]+)", line):
        b.fact("handles_error", source, m[1], line=n, form="errors.Is" if "errors.Is" in line else "errors.As")
    if m := re.match(r"\s*return .*fmt\.Errorf\(\"[^\"]*%w", line):
        b.fact("wraps_error", source, "error", "type", n, form="fmt.Errorf")
    elif re.match(r"\s*return (?:.*, )?err$", line):
        b.fact("propagates_error", source, "error", "type", n, form="return")
    elif m := re.match(r"\s*return (?:.*, )?(Err\w+)$", line):
        b.fact("returns_error", source, m[1], line=n, form="sentinel")


TYPED = re.compile(r"\b(\w+)\s*:?=\s*&?(?:\w+\.)?([A-Z]\w*)\{|\bvar (\w+) \*?(?:\w+\.)?([A-Z]\w*)\b|[(,]\s*(\w+) \*?(?:\w+\.)?([A-Z]\w*)(?=\s*[,)])")
CODEC = re.compile(r"\b(?:proto|protojson|prototext)\.(Marshal|Unmarshal)\(")


def _go_codecs(b: Builder, source: str, lines: list[str], n: int, types: dict[str, str]) -> None:
    """Messages that a function encodes or decodes: the type is that of a literal, or of
    a variable or parameter whose type is written out in the function."""
    line = lines[n - 1]
    for m in TYPED.finditer(line):
        name, kind = next((m[i], m[i + 1]) for i in (1, 3, 5) if m[i])
        types[name] = kind
    for m in CODEC.finditer(line):
        given = _pieces(_bracketed(lines, n - 1, m.end() - 1))
        encodes = m[1] == "Marshal"
        if len(given) <= (not encodes):
            continue
        argument = given[0 if encodes else 1]
        literal = re.match(r"&?(?:\w+\.)?([A-Z]\w*)\{", argument)
        kind = literal[1] if literal else types.get(argument.lstrip("&*"), "")
        if kind:
            b.fact("encodes" if encodes else "decodes", source, kind, "type", n, codec="protobuf")
