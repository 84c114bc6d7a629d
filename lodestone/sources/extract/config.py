"""Configuration files and dependency manifests."""

from __future__ import annotations

import json
import re
import tomllib

from .builder import Builder, Result

SUFFIXES = (".env", ".yaml", ".yml", ".properties", ".json", ".toml")
REFERENCE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_.-]*)[^}]*\}")


def _flat(value, prefix: str = ""):
    for k, v in value.items() if isinstance(value, dict) else ():
        key = f"{prefix}.{k}" if prefix else str(k)
        yield from _flat(v, key) if isinstance(v, dict) and v else [(key, v)]


def _lines(text: str, kind: str):
    """(key, value, line) of the line formats."""
    stack: list[tuple[int, str]] = []
    for n, raw in enumerate(text.splitlines(), 1):
        line = raw.strip()
        if not line or line[0] in "#!" or kind == "yaml" and (line.startswith("- ") or line in ("-", "---")):
            continue
        if kind == "env":
            key, sep, value = line.removeprefix("export ").partition("=")
        elif kind == "properties":
            m = re.match(r"([^=:]+?)\s*([=:])\s*(.*)", line)
            key, sep, value = m.groups() if m else ("", "", "")
        else:
            m = re.match(r"(['\"]?)([^'\":{}\[\]]+)\1\s*:(?:\s+(.*))?$", line)
            key, sep, value = (m[2], ":", m[3] or "") if m else ("", "", "")
            if m:
                indent = len(raw) - len(raw.lstrip())
                stack = [s for s in stack if s[0] < indent]
                stack.append((indent, key.strip()))
                key = ".".join(s for _, s in stack)
                if not value.strip():
                    continue
        if sep and key.strip():
            yield key.strip(), value, n


def parse(repository: str, path: str, text: str) -> Result:
    b = Builder(repository, path, "config", text.count("\n") + 1)
    kind = "env" if path.rsplit("/", 1)[-1].startswith(".env") or path.endswith(".env") else path.rsplit(".", 1)[-1].replace("yml", "yaml")
    try:
        if kind in ("json", "toml"):
            data = json.loads(text) if kind == "json" else tomllib.loads(text)
            items = [(k, v if isinstance(v, str) else "", 1) for k, v in (sorted(_flat(data), key=lambda p: p[0]) if kind == "toml" else _flat(data))]
        else:
            items = list(_lines(text, kind))
    except (ValueError, RecursionError) as e:
        b.problem(1, "error", f"invalid {kind}: {e}")
        items = []
    for key, value, line in items:
        node = b.node("config_key", key, f"config:{path}:{key}", line, defined="true", format=kind)
        b.fact("defines", b.file, target_id=node, line=line)
        for m in REFERENCE.finditer(value):
            b.fact("references", node, m[1], "config_key", line)
    return b.result()


# ---- manifests ------------------------------------------------------------------

NPM_SCOPES = (("dependencies", "runtime"), ("optionalDependencies", "optional"), ("peerDependencies", "peer"), ("devDependencies", "development"))


def is_manifest(path: str) -> bool:
    name = path.rsplit("/", 1)[-1]
    return name in ("go.mod", "package.json") or bool(re.fullmatch(r"requirements.*\.txt", name))


def parse_manifest(repository: str, path: str, text: str) -> Result:
    b = Builder(repository, path, "manifest", text.count("\n") + 1)
    name = path.rsplit("/", 1)[-1]
    if name == "go.mod":
        _go_mod(b, text)
    elif name == "package.json":
        try:
            data = json.loads(text)
        except ValueError as e:
            b.problem(1, "error", f"invalid JSON: {e}")
            return b.result()
        owner = b.declare(b.file, "module", data.get("name") or path, data.get("name") or path, 1, language="npm-manifest") if data.get("name") else b.file
        seen: set[str] = set()
        for section, scope in NPM_SCOPES:
            for dep, version in sorted((data.get(section) or {}).items()):
                if dep not in seen:
                    seen.add(dep)
                    b.fact("depends_on", owner, dep, "module", 1, ecosystem="npm", version=str(version), scope=scope)
    else:
        scope = "development" if re.search("dev|test", name) else "runtime"
        repo = b.node("repository", repository, repository, 1)
        for n, line in enumerate(text.splitlines(), 1):
            m = re.match(r"\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*([^#;]*)", line)
            if m and "://" not in line and not line.lstrip().startswith("-"):
                b.fact("depends_on", repo, re.sub(r"[-_.]+", "-", m[1]).lower(), "module", n, ecosystem="pypi", version=m[2].strip(), scope=scope)
    return b.result()


def _go_mod(b: Builder, text: str) -> None:
    owner, block = b.file, ""
    replaced: dict[str, str] = {m[1]: m[2] for m in re.finditer(r"(?m)^\s*(?:replace\s+)?(\S+)(?:\s+v\S+)?\s+=>\s+(\S+)", text)}
    for n, raw in enumerate(text.splitlines(), 1):
        line = raw.split("//")[0].strip()
        if m := re.match(r"module\s+(\S+)", line):
            owner = b.declare(b.file, "module", m[1], m[1], n, language="go-module")
        elif m := re.match(r"(require|replace|exclude|retract)\s*\($", line):
            block = m[1]
        elif line == ")":
            block = ""
        elif m := re.match(r"(?:require\s+)?([^\s()]+)\s+(v\S+)$", line):
            if block == "require" or line.startswith("require"):
                b.fact("depends_on", owner, m[1], "module", n, ecosystem="go", version=m[2], scope="runtime", indirect="true" if "// indirect" in raw else "", replacement=replaced.get(m[1], ""))
