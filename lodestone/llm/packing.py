"""Sequence packing, bounded-space and online.

Each task reads its rows once and keeps a fixed number of open windows. A
document's ids are cut into full windows, which leave at once, and a rest, which
goes into the open window with the least sufficient room (best fit). When none has
room and all are open, the fullest is emitted. What is open at a task's end is
merged by the same rule in a second, much smaller step over windows, not rows.

Sequence ids: ``task << 40 | counter`` in the first step; in the second step the
merged windows take the smallest id among those they absorb. Results for odd
input: a null text is the empty text (its one piece is the closing id); repeated
rows are packed each; an empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import codecs
import functools
import gc
import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, forgotten_with, frugal, stored

Encoder = Callable[[list[str]], list[array]]


# Where a byte-level pre-tokenizer cuts whatever else the text holds: before a single
# space between two other characters.
CUT = re.compile(r"(?<=\S) (?=\S)")
# Marks that are a piece of their own behind a letter and before white space, however many.
CLOSING = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MOST_LATIN = "\xff"
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_HIDDEN = iter(range(256, 512))
#: What a byte-level vocabulary writes for each byte, but a space that stays one.
BYTE_LEVEL = "".join(chr(b if b in _SHOWN else next(_HIDDEN)) for b in range(256)).replace("\u0120", " ")


def lines_of(word: str) -> list[str]:
    """The word cut at single line ends inside it, each a piece of its own; uncut where
    other white space is beside one."""
    lines = word.split("\n")
    return lines if all(w and w == w.strip() for w in lines) else [word]


def stem_of(word: str) -> str:
    """The word without its closing marks, if a letter is before them."""
    stem = word.rstrip(CLOSING)
    return stem if stem and stem[-1].isalpha() and stem[-1] <= MOST_LATIN else word


@functools.cache
def byte_bpe_encoder(path: str, end_id: int = 0, most: int = 250_000) -> Encoder:
    """Ids of a byte-level BPE ``tokenizer.json``, each text followed by
    ``end_id``, as arrays of unsigned 32-bit integers.

    All ids come from the tokenizers library. Texts are cut where its pre-tokenizer
    cuts them in any case, and each distinct word is encoded once; some ``most`` words
    of 64 characters at most are remembered, by a worker for all its tasks. Words that
    follow a single space go to the library many at a time: each begins with the one
    token of its own that starts with a space, so the ids fall apart again. Files with
    another pre-tokenizer and texts that hold one of the file's special strings are
    encoded whole.
    """
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import WhitespaceSplit

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    spec = json.load(open(path, encoding="utf-8"))
    library = Tokenizer.from_file(path)
    letters = Tokenizer(library.model)
    letters.pre_tokenizer = WhitespaceSplit()
    special = [t["content"] for t in spec["added_tokens"]]
    before = spec["pre_tokenizer"] or {}
    apart = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    apart = apart and not any(spec.get(k) for k in ("normalizer", "truncation", "padding")) and not spec["model"].get("dropout")
    vocabulary = library.get_vocab()
    # The byte-level form of a space is U+0120.
    begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
    begins[[i for w, i in vocabulary.items() if w.startswith("\u0120")]] = True
    line_end = array("I", library.encode("\n", add_special_tokens=False).ids).tobytes()
    spaced, alone = Recent(most), Recent(most)  # words after a space; other pieces

    def cut(text: str) -> tuple[list[str], list[str]]:
        """The text's pieces: those to encode as they are, and words after a space."""
        if not text:
            return [], []
        if not apart or any(s in text for s in special):
            return [text], []
        words = text.split(" ")
        first = words[:1]
        return (first, words[1:]) if first[0] and first[0] == first[0].strip() else ([], [""])

    def cut_unevenly(text: str) -> tuple[list[str], list[str]]:
        first, *others = CUT.split(text)
        return [first, *[" " + w for w in others]], []

    def learn(words: list[str], group: int = 200) -> None:
        # A word of letters is one piece: the library's model takes its bytes as they are,
        # without its pre-tokenizer.
        plain = {w for w in words if w.isalpha() and (w.isascii() or max(w) <= MOST_LATIN)}
        for encoder, mark, some in ((letters, "\u0120", list(plain)), (library, "", [w for w in words if w not in plain])):
            lines = [some[at : at + group] for at in range(0, len(some), group)]
            for lo in range(0, len(lines), 50):  # the library's results are large
                part = lines[lo : lo + 50]
                joined = [byte_level(" ".join(line)) if mark else " " + " ".join(line) for line in part]
                for line, e in zip(part, encoder.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                    ids = np.array(e.ids, "<u4")
                    data, at = ids.tobytes(), (np.flatnonzero(begins[ids]) * 4).tolist()
                    spaced.now.update(zip(line, [data[a:b] for a, b in zip(at, [*at[1:], len(data)], strict=True)], strict=True))

    def byte_level(line: str) -> str:
        shown = line if line.isascii() else codecs.charmap_decode(line.encode(), "strict", BYTE_LEVEL)[0]
        return "\u0120" + shown.replace(" ", " \u0120")

    def learn_alone(words: list[str]) -> None:
        for lo in range(0, len(words), 4_000):
            some = words[lo : lo + 4_000]
            for word, e in zip(some, library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                alone.now[word] = array("I", e.ids).tobytes()

    def encode(texts: list[str]) -> list[array]:
        # Nothing here refers to itself, and there are many lists for the collector to follow.
        collects = gc.isenabled()
        gc.disable()
        try:
            return encode_all(texts)
        finally:
            if collects:
                gc.enable()

    def encode_all(texts: list[str]) -> list[array]:
        spaced.turn()
        alone.turn()
        parts = [cut(t) for t in texts]
        pieces, words = set(), set()
        for p, w in parts:
            pieces.update(p)
            words.update(w)
        fresh = spaced.miss(words)
        # Beside a word that begins or ends with white space not every space is a cut.
        if odd := {w for w in fresh if w != w.strip() or not w}:
            for i, (_, w) in enumerate(parts):
                if not odd.isdisjoint(w):
                    parts[i] = cut_unevenly(texts[i])
                    pieces.update(parts[i][0])
            fresh -= odd
        # Most new words are known ones with closing marks, or two with a line end between.
        broken = {w: lines_of(w) for w in fresh if "\n" in w} if apart else {}
        broken = {w: lines for w, lines in broken.items() if len(lines) > 1}
        whole = fresh.difference(broken)
        whole |= spaced.miss({lines[0] for lines in broken.values()})
        pieces.update(line for lines in broken.values() for line in lines[1:])
        ends = [w for w in whole if not w[-1].isalnum()]
        shorter = list(map(stem_of, ends))
        closed = [(w, stem, w[len(stem) :]) for w, stem in zip(ends, shorter, strict=True) if stem is not w]
        stems = spaced.miss({stem for _, stem, _ in closed})
        pieces.update([marks for _, _, marks in closed])
        fresh_alone = alone.miss(pieces)
        learn(list(whole.difference([w for w, _, _ in closed]) | stems))
        learn_alone(list(fresh_alone))
        now, by_itself = spaced.now, alone.now
        now.update([(w, now[stem] + by_itself[marks]) for w, stem, marks in closed])
        now.update([(w, line_end.join([now[first], *map(by_itself.__getitem__, others)])) for w, (first, *others) in broken.items()])
        fresh |= whole | stems
        out = []
        for p, w in parts:
            ids = array("I", b"".join([*map(alone.now.__getitem__, p), *map(spaced.now.__getitem__, w)]))
            ids.append(end_id)
            out.append(ids)
        for known, some in ((spaced, fresh), (alone, fresh_alone)):
            for word in [w for w in some if len(w) > 64]:
                del known.now[word]
        return out

    return encode


forgotten_with(byte_bpe_encoder.cache_clear)


class Windows:
    """Open windows of one task: at most ``most``, kept sorted by their room."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.open: list[tuple[int, int]] = []  # (room, window), ascending

    def place(self, size: int, fresh: Callable[[], int], emit: Callable[[int, int], None]) -> tuple[int, int]:
        """(window, offset) for a piece of ``size``; ``emit`` gets a window that
        closes and the room it leaves."""
        at = bisect.bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, window = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                left, fullest = self.open.pop(0)
                emit(fullest, left)
            room, window = self.capacity, fresh()
        if room > size:
            bisect.insort(self.open, (room - size, window))
        else:
            emit(window, 0)
        return window, self.capacity - room


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open_room long"


def _pieces(docs: DataFrame, encoder: Callable[[], Encoder], capacity: int, most: int, with_ids: bool, id_col: str, text_col: str, bytes_at_once: int = 1 << 20) -> DataFrame:
    rows = docs.select(id_col, text_col)
    id_type = rows.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, {PIECE}" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        base, counter = TaskContext.get().partitionId() << 40, 0
        windows = Windows(capacity, most)

        def fresh() -> int:
            nonlocal counter
            counter += 1
            return base + counter - 1

        waiting: dict[int, list[tuple]] = {}  # pieces of the open windows
        done: list[tuple] = []

        def emit(window: int, left: int) -> None:
            done.extend(waiting.pop(window, ()))

        def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True)) or [()] * (8 + with_ids)
            types = [id_arrow, *[pa.int64()] * 7, *[pa.list_(pa.int64())] * with_ids]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "open_room"]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names + ["ids"] * with_ids
            )

        id_arrow = pa.int64()
        for batch in batches:
            id_arrow = batch.schema.field(0).type
            keys = batch.column(0).to_pylist()
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = (np.flatnonzero(np.diff(np.cumsum(sizes) // bytes_at_once)) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                for key, ids in zip(keys[lo:hi], encode(texts), strict=True):
                    total = len(ids)
                    for start in range(0, total, capacity):
                        part = ids[start : start + capacity]
                        closing: list[int] = []
                        window, offset = windows.place(len(part), fresh, lambda w, left, c=closing: c.append(w))
                        piece = (key, start, len(part), zlib.crc32(part.tobytes()), total, window, offset, 0)
                        piece += (part.tolist(),) if with_ids else ()
                        waiting.setdefault(window, []).append(piece)
                        for w in closing:
                            emit(w, 0)
                if len(done) >= 5_000:
                    yield batch_of(done)
                    done = []
        room = {window: left for left, window in windows.open}
        for window, pieces in waiting.items():
            done.extend((*p[:7], room[window], *p[8:]) for p in pieces)
        yield batch_of(done)

    return rows.mapInArrow(frugal(run), schema)


def _merge(groups: DataFrame, capacity: int, most: int) -> DataFrame:
    """(window, used, g) -> (window, new_id, shift), packed group by group."""

    def run(table: pa.Table) -> pa.Table:
        order = sorted(zip(table["used"].to_pylist(), table["window"].to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
        windows = Windows(capacity, most)
        placed: list[tuple[int, int, int]] = []
        current = {"id": 0}

        def fresh() -> int:
            return current["id"]

        for used, window in order:
            current["id"] = window
            target, shift = windows.place(used, fresh, lambda w, left: None)
            placed.append((window, target, shift))
        columns = list(zip(*placed, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("window", "new_id", "shift"), columns, strict=True)})

    return groups.groupBy("g").applyInArrow(run, "window long, new_id long, shift long")


def pack(docs: DataFrame, encoder: Callable[[], Encoder], capacity: int = 1024, most_open: int = 64, windows_per_merge: int = 20_000, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and with ``with_ids`` the piece's ids.

    ``encoder`` is called once a task and returns the encoding function. Texts are
    encoded once; the pieces are kept in the shared folder. The second step deals
    the open windows (at most ``most_open`` a task) to groups of about
    ``windows_per_merge`` by hash, so no group grows with the input.
    """
    pieces = stored(_pieces(docs, encoder, capacity, most_open, with_ids, id_col, text_col), "pieces")
    left = pieces.where("open_room > 0")
    used = left.groupBy(F.col("sequence_id").alias("window")).agg(F.sum("length").alias("used"))
    n_open = left.select("sequence_id").distinct().count()
    n_groups = max(1, -(-n_open // windows_per_merge))
    groups = used.withColumn("g", F.pmod(F.xxhash64("window"), F.lit(n_groups)))
    moved = _merge(groups, capacity, most_open)
    again = (
        left.join(moved, left["sequence_id"] == moved["window"])
        .withColumn("sequence_id", F.col("new_id"))
        .withColumn("offset", F.col("offset") + F.col("shift"))
        .select(*pieces.columns)
    )
    return pieces.where("open_room = 0").unionByName(again).drop("open_room")
