"""Secret scans: an Aho-Corasick automaton finds keywords, anchored regular
expressions run only where a keyword was hit, and kinds that embed a checksum or
a self-describing header are validated before they count.

Results for odd input: a null text is scanned as the empty text (no spans);
offsets are code points, end exclusive; repeated rows are scanned each; columns
other than the two named ones are never looked at.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import frugal

# The kinds in reporting order. The first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "slack", "stripe", "google", "pem")
BASE_KINDS = KINDS[:3]

# Keyword (lower case) -> kind tried at the keyword's position.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign",
    "apikey": "assign", "api_key": "assign", "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm", "eyj": "jwt", "xoxb-": "slack", "xoxp-": "slack", "xoxa-": "slack",
    "sk_live_": "stripe", "rk_live_": "stripe", "aiza": "google", "-----begin ": "pem",
}

ANCHORED = {
    "assign": re.compile(
        r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
    ),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "jwt": re.compile(r"(eyJ[A-Za-z0-9_-]{8,}+)\.(eyJ[A-Za-z0-9_-]{2,}+)\.[A-Za-z0-9_-]{16,}"),
    "slack": re.compile(r"xox[abp]-[0-9]{9,13}-[0-9A-Za-z-]{16,}"),
    "stripe": re.compile(r"[sr]k_live_[A-Za-z0-9]{24,}"),
    "google": re.compile(r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"),
    "pem": re.compile(r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\s]{64,}-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
}
#: A kind whose pattern begins with an unbounded run: where it fails at one keyword, it
#: fails at every later one in the same run, so the run is read once.
RUNS = {"jwt": re.compile(r"[A-Za-z0-9_-]*+")}
#: Runs of lower-case hex have no keyword; the run itself is the anchor.
HEX_RUN = re.compile(r"[0-9a-f]{24,}")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: str) -> str:
    """CRC-32 of ``body`` in six base-62 digits, zero-padded on the left."""
    value, digits = zlib.crc32(body.encode()), []
    for _ in range(6):
        value, d = divmod(value, 62)
        digits.append(BASE62[d])
    return "".join(reversed(digits))


def _json_header(part: str) -> bool:
    try:
        header = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error):
        return False
    return isinstance(header, dict) and "alg" in header


def accepted(kind: str, m: re.Match) -> bool:
    """The check that follows a match: length floors of the base kinds, the
    embedded checksum or header of the others."""
    if kind == "assign":
        return m.end(1) - m.start(1) >= 6
    if kind == "access":
        return m.end() - m.start() >= 20
    if kind in ("github", "npm"):
        return base62_crc(m[1]) == m[2]
    if kind == "jwt":
        return _json_header(m[1])
    return True


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def scan(text: str | None, keywords: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) sorted by start, then by the order of ``KINDS``.

    Per kind the matches are the leftmost non-overlapping ones: hits of one kind
    arrive in order of their start because no keyword
    contains another, and a hit inside the kind's previous match is skipped. A match that
    fails its check still uses up its characters.
    """
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # some letters lower to two; keep positions
        low = text.translate(_ASCII_LOWER)
    found, used = [], dict.fromkeys(ANCHORED, 0)
    for last, (size, kind) in keywords.iter(low):
        at = last - size + 1
        if at < used[kind]:
            continue
        if m := ANCHORED[kind].match(text, at):
            used[kind] = m.end()
            if accepted(kind, m):
                found.append((at, m.end(), kind))
        elif kind in RUNS:
            used[kind] = RUNS[kind].match(text, at).end()
    found += [(m.start(), m.end(), "hex") for m in HEX_RUN.finditer(text)]
    if len(found) > 1:
        found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with every span replaced by ``[SECRET]``; overlapping spans merge."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, the counts of the base kinds, the digest of
    the base spans and all spans. A narrow map: no shuffle, one batch in memory."""
    rows = docs.select(id_col, text_col)
    id_type = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for text in batch.column(1):
                spans = scan(text.as_py(), keywords)
                base = [s for s in spans if s[2] in BASE_KINDS]
                for kind in BASE_KINDS:
                    cols[f"n_{kind}"].append(sum(s[2] == kind for s in base))
                cols["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols["spans"].append(joined(spans))
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(v, t) for v, t in zip(cols.values(), types, strict=True))],
                names=[id_col, *cols],
            )

    return rows.mapInArrow(frugal(run), f"`{id_col}` {id_type}, {RESULT}")


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The same rows and columns with every secret in ``text_col`` replaced;
    ``length_col``, if there, is brought in line where the text changed."""
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            changed = {i: redact(t, s) for i, t in enumerate(texts) if (s := scan(t, keywords))}
            arrays = list(batch.columns)
            if changed:
                arrays[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], batch.schema.field(at).type)
                if length_at is not None:
                    lengths = batch.column(length_at).to_pylist()
                    arrays[length_at] = pa.array(
                        [len(changed[i]) if i in changed else n for i, n in enumerate(lengths)],
                        batch.schema.field(length_at).type,
                    )
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(frugal(run), docs.schema)
