"""SQL schemas and queries: a tokenizer and a statement reader that cover the common
ground of the SQLite and PostgreSQL dialects."""

from __future__ import annotations

import re

from .builder import Builder, Result

SUFFIXES = (".sql", ".pgsql", ".psql")
TOKEN = re.compile(
    r"--[^\n]*|/\*.*?\*/|\$(\w*)\$.*?\$\1\$|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|\[[^\]]+\]|[A-Za-z_][\w$]*|\d+(?:\.\d+)?|.", re.S
)
STOP = frozenset("where group order having limit union on using set values select join inner left right full cross natural as returning from when window intersect except offset".split())
CONSTRAINTS = frozenset("primary foreign unique check constraint exclude like".split())
NAMED_QUERY = re.compile(r"--\s*name:\s*(\w+)\s*:(\w+)")


class Token(str):
    line: int

    def __new__(cls, text: str, line: int):
        t = super().__new__(cls, text)
        t.line = line
        return t


def tokens(text: str) -> list[Token]:
    out, line = [], 1
    for m in TOKEN.finditer(text):
        t = m[0]
        if not t.isspace() and not t.startswith(("--", "/*")):
            out.append(Token(t, line))
        line += t.count("\n")
    return out


def statements(text: str) -> list[list[Token]]:
    """Token lists between semicolons; the body of a trigger or function is one."""
    out: list[list[Token]] = [[]]
    depth = begin = 0
    for t in tokens(text):
        low = t.lower()
        depth += (t == "(") - (t == ")")
        if low == "begin" and out[-1] and out[-1][0].lower() == "create":
            begin += 1
        elif low == "end" and begin:
            begin -= 1
        if t == ";" and depth <= 0 and not begin:
            out.append([])
            depth = 0
        else:
            out[-1].append(t)
    return [s for s in out if s]


def name_at(s: list[Token], i: int) -> tuple[str, int]:
    """A possibly qualified name at ``i``, and where it ends."""
    parts = []
    while i < len(s) and re.match(r"[A-Za-z_\"`\[]", s[i]):
        parts.append(s[i].strip('"`[]'))
        i += 1
        if i < len(s) and s[i] == ".":
            i += 1
            continue
        break
    return ".".join(parts), i


def skip_words(s: list[Token], i: int, *words: str) -> int:
    while i < len(s) and s[i].lower() in words:
        i += 1
    return i


class _Reader:
    def __init__(self, b: Builder):
        self.b = b

    def create(self, s: list[Token]) -> None:
        i = skip_words(s, 1, "or", "replace", "temp", "temporary", "unlogged", "virtual", "materialized", "unique", "recursive", "global", "local")
        if i >= len(s):
            return
        what = s[i].lower()
        j = skip_words(s, i + 1, "if", "not", "exists", "concurrently")
        name, j = name_at(s, j)
        if not name:
            return
        line, end = s[0].line, s[-1].line
        if what == "table":
            table = self.b.declare(self.b.file, "table", name.rsplit(".", 1)[-1], name, line, end)
            if j < len(s) and s[j] == "(":
                self.columns(s, j + 1, table, name)
            else:
                self.uses(s[j:], table)
        elif what == "view":
            self.uses(s[j:], self.b.declare(self.b.file, "view", name.rsplit(".", 1)[-1], name, line, end))
        elif what == "index":
            index = self.b.declare(self.b.file, "index", name, name, line, end)
            on = next((k for k in range(j, len(s)) if s[k].lower() == "on"), None)
            if on is not None:
                self.b.fact("references", index, name_at(s, skip_words(s, on + 1, "only"))[0], "table", s[on].line)
        elif what in ("trigger", "function", "procedure"):
            f = self.b.declare(self.b.file, "function", name.rsplit(".", 1)[-1], name, line, end)
            on = next((k for k in range(j, len(s)) if s[k].lower() == "on"), None)
            if what == "trigger" and on is not None:
                self.b.fact("references", f, name_at(s, on + 1)[0], "table", s[on].line)
            self.uses(s[j:], f)

    def columns(self, s: list[Token], i: int, table: str, name: str) -> None:
        depth, item, items = 1, [], []
        for t in s[i:]:
            depth += (t == "(") - (t == ")")
            if depth == 0:
                break
            if t == "," and depth == 1:
                items.append(item)
                item = []
            else:
                item.append(t)
        for item in [*items, item]:
            if not item:
                continue
            low = [t.lower() for t in item]
            if low[0] not in CONSTRAINTS:
                column = item[0].strip('"`[]')
                text = " ".join(low)
                kind = low[1] if len(low) > 1 and re.match(r"[a-z]", low[1]) and low[1] not in CONSTRAINTS | {"not", "default", "references"} else ""
                flags = {"not_null": "not null", "primary_key": "primary key", "autoincrement": "autoincrement", "unique": "unique", "generated": "generated"}
                key = self.b.node("column", column, f"{name}.{column}", item[0].line, type=kind, **{k: "true" for k, w in flags.items() if w in text})
                self.b.fact("has_field", table, target_id=key, line=item[0].line)
            for k, word in enumerate(low):
                if word == "references":
                    self.b.fact("references", table, name_at(item, k + 1)[0], "table", item[k].line)

    def uses(self, s: list[Token], owner: str) -> None:
        """Reads and writes of tables, once per statement, and the column reads that
        an alias or an only relation proves."""
        low = [t.lower() for t in s]
        ctes = {s[k - 1].lower().strip('"') for k in range(1, len(s) - 1) if low[k] == "as" and s[k + 1] == "(" and (k < 2 or low[k - 2] in ("with", ",", "recursive"))}
        seen: set[tuple[str, str]] = set()
        aliases: dict[str, str] = {}

        def touch(kind: str, k: int) -> int:
            name, end = name_at(s, skip_words(s, k, "only", "lateral"))
            if not name or name.lower() in STOP or (end < len(s) and s[end] == "(" and kind == "reads"):
                return k
            if name.lower() in ctes:
                return end
            if (kind, name) not in seen:
                seen.add((kind, name))
                self.b.fact(kind, owner, name, line=s[k].line if k < len(s) else s[-1].line)
            at = skip_words(s, end, "as")
            if at < len(s) and re.match(r"[A-Za-z_]", s[at]) and low[at] not in STOP:
                aliases[low[at]] = name
            aliases[name.lower().rsplit(".", 1)[-1]] = name
            return end

        i = 0
        while i < len(s):
            w = low[i]
            if w in ("from", "join") and not (w == "from" and i and low[i - 1] in ("delete", "distinct")):
                i = touch("reads", i + 1)
                while i < len(s) and (s[i] == "," or low[i] in aliases or low[i] == "as"):
                    i = touch("reads", i + 1) if s[i] == "," and w == "from" and i + 1 < len(s) and s[i + 1] != "(" else i + 1
                continue
            if w == "into" and i and low[i - 1] in ("insert", "replace", "ignore", "merge") or w == "into" and "insert" in low[max(0, i - 3) : i]:
                i = touch("writes", i + 1)
                continue
            if w == "update" and (i == 0 or low[i - 1] not in ("for", "do", "on", "before", "after", "of", "or")):
                i = touch("writes", skip_words(s, i + 1, "or", "replace", "ignore"))
                continue
            if w == "delete" and i + 1 < len(s) and low[i + 1] == "from":
                i = touch("writes", i + 2)
                continue
            i += 1
        proven: set[str] = set()
        for k in range(len(s) - 2):
            if s[k + 1] == "." and low[k] in aliases and re.match(r"[A-Za-z_\"]", s[k + 2]) and (k + 3 >= len(s) or s[k + 3] != "("):
                column = f"{aliases[low[k]]}.{s[k + 2].strip(chr(34))}"
                if column not in proven and aliases[low[k]].lower() not in ctes:
                    proven.add(column)
                    self.b.fact("reads", owner, column, "column", s[k].line)

    def alter(self, s: list[Token]) -> None:
        i = skip_words(s, 2, "if", "exists", "only")
        name, _ = name_at(s, i)
        if len(s) > 1 and s[1].lower() in ("table", "view") and name:
            self.b.fact("writes", self.b.file, name, s[1].lower(), s[0].line)


def parse(repository: str, path: str, text: str) -> Result:
    b = Builder(repository, path, "sql", text.count("\n") + 1)
    r = _Reader(b)
    names = {text[: m.start()].count("\n") + 1: (m[1], m[2]) for m in NAMED_QUERY.finditer(text)}
    for s in statements(text):
        head = s[0].lower()
        if head == "create":
            r.create(s)
        elif head in ("alter", "drop"):
            r.alter(s)
        elif head in ("select", "insert", "update", "delete", "with", "replace", "merge"):
            owner = b.file
            above = [n for n in names if n < s[0].line and not any(o > n and o < s[0].line for o in names)]
            if above:
                name, form = names.pop(max(above))
                owner = b.declare(b.file, "sql_query", name, f"{path}:{name}", s[0].line, s[-1].line, command=form)
            r.uses(s, owner)
    return b.result()
