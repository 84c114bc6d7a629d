"""Markdown: sections and what they document."""

from __future__ import annotations

import posixpath
import re

from .builder import Builder, Result

SUFFIXES = (".md", ".markdown")
HEADING, FENCE = re.compile(r"(#{1,6})\s+(.+?)\s*#*\s*$"), re.compile(r"\s*(```|~~~)")
LINK = re.compile(r"(?<!!)\[[^\]]*\]\(([^)\s]+)[^)]*\)")
NAMED = re.compile(r"(?i)\b(function|method|class|interface|type|endpoint)\s+`([^`]+)`")


def anchor(title: str) -> str:
    out = ""
    for c in title:
        if c.isalnum():
            out += c.lower()
        elif c in " -" and not out.endswith("-"):
            out += "-"
    return out.strip("-") or "section"


def parse(repository: str, path: str, text: str) -> Result:
    b = Builder(repository, path, "markdown", text.count("\n") + 1)
    lines = text.splitlines()
    heads: list[tuple[int, int, str]] = []
    fenced, plain = False, set()
    for n, line in enumerate(lines, 1):
        if FENCE.match(line):
            fenced = not fenced
        elif not fenced:
            plain.add(n)
            if m := HEADING.match(line):
                heads.append((n, len(m[1]), m[2]))
    used: dict[str, int] = {}
    stack: list[tuple[int, str]] = []
    starts: list[tuple[int, str]] = []
    for i, (n, level, title) in enumerate(heads):
        end = next((m - 1 for m, other, _ in heads[i + 1 :] if other <= level), len(lines))
        base = anchor(title)
        slug = base if base not in used else f"{base}-{used[base]}"
        used[base] = used.get(base, 0) + 1
        key = b.node("document_section", title, f"{path}#{slug}", n, end, anchor=slug, level=str(level))
        stack = [s for s in stack if s[0] < level]
        b.fact("contains", stack[-1][1] if stack else b.file, target_id=key, line=n)
        stack.append((level, key))
        starts.append((n, key))
    for n in sorted(plain):
        line = lines[n - 1]
        section = next((k for m, k in reversed(starts) if m <= n), b.file)
        for m in LINK.finditer(line):
            target, _, slug = m[1].partition("#")
            if re.match(r"[a-z][a-z0-9+.-]*:|//", target):
                continue
            full = posixpath.normpath(posixpath.join(posixpath.dirname(path), target)) if target else path
            if not full.startswith(".."):
                name, kind = (f"{full}#{slug}", "document_section") if slug else (f"{repository}:{full}", "file")
                b.fact("documents", section, name, kind, n)
        for m in NAMED.finditer(line):
            b.fact("documents", section, m[2].removesuffix("()"), m[1].lower(), n)
    return b.result()
