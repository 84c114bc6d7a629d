"""SentencePiece models run by the tokenizers library.

The model's protobuf is parsed here and rebuilt: its normaliser, the metaspace
marker, the vocabulary with its scores (unigram) or the merges that its scores imply
(byte-pair), and byte fallback. Texts are encoded word by word where no piece of the
vocabulary reaches over a space, which the vocabulary is searched for; each distinct
word is encoded once, many words a line in multithreaded batches of lines, its ids are
compared with those of the SentencePiece library, and decoded again. A text's ids are
its words' ids in order. A worker remembers words for all its tasks.

Results for odd input: null and empty texts give no ids; a word on which the two
libraries differ keeps the rebuilt model's ids and marks the text's ``parity`` false;
repeated rows are encoded each.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Recent, forgotten_with, frugal

MARK = "\u2581"
# Fixed values of the format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protobuf message; fixed32 as raw bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """What encoding needs of a SentencePiece model file."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.charsmap = UNIGRAM, b""
        self.prefix = self.squeeze = self.escape = True
        for number, value in wire(data):
            if number == 1:
                parts = dict(wire(value))
                score = struct.unpack("<f", parts[2])[0] if 2 in parts else 0.0
                self.pieces.append((parts.get(1, b"").decode(), score, parts.get(3, NORMAL)))
            elif number == 2:
                self.kind = dict(wire(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(wire(value))
                self.charsmap = spec.get(2, b"")
                self.prefix, self.squeeze, self.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.bytes_at = {int(p[0][1:-1], 16): i for i, p in enumerate(self.pieces) if p[2] == BYTE}
        usable = [p for p, _, t in self.pieces if t in (NORMAL, USER_DEFINED)]
        #: Whether words can be encoded apart: no piece has the mark after a letter.
        self.by_word = not any(MARK in p.lstrip(MARK) for p in usable)

    def merges(self) -> list[tuple[str, str]]:
        """Every way to build a piece from two, best piece first."""
        rank = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER_DEFINED, UNUSED)}
        found = []
        for p, i in rank.items():
            for cut in range(1, len(p)):
                left, right = rank.get(p[:cut]), rank.get(p[cut:])
                if left is not None and right is not None:
                    found.append((-self.pieces[i][1], i, left, right, p[:cut], p[cut:]))
        return [(a, b) for *_, a, b in sorted(found)]

    def tokenizer(self):
        from tokenizers import Tokenizer, models, normalizers

        if self.kind == UNIGRAM:
            vocab = [(p, s) for p, s, _ in self.pieces]
            made = Tokenizer(models.Unigram(vocab, unk_id=self.unknown, byte_fallback=bool(self.bytes_at)))
        elif self.kind == BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            made = Tokenizer(
                models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=bool(self.bytes_at))
            )
        else:
            raise ValueError("only unigram and byte-pair models are rebuilt")
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        made.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        return made


class Codec:
    """Encodes and decodes with one model; remembers some ``most`` words."""

    WORD = re.compile(f" +[^ {MARK}]*|[^ {MARK}]+|{MARK}[^ {MARK}]*")

    def __init__(self, path: str, most: int = 100_000):
        import sentencepiece

        data = open(path, "rb").read()
        self.model = Model(data)
        self.library = self.model.tokenizer()
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.known = Recent(most)  # word -> its ids, 32 bits each
        self.unlike: set[str] = set()  # words on which the libraries differ
        self.changed: set[str] = set()  # words that decoding does not give back
        self.bytes_of = []
        for piece, _, kind in self.model.pieces:
            if kind == BYTE:
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
            elif kind == UNKNOWN:
                self.bytes_of.append(" \u2047 ".encode())
            else:
                self.bytes_of.append(b"" if kind == CONTROL else piece.replace(MARK, " ").encode())
        self.begins = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])

    def prepared(self, text: str) -> str:
        """The text as its words are cut from it: the spaces that the model drops
        are dropped, the one that it puts in front is there."""
        if self.model.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return " " + text if self.model.prefix and text else text

    def words(self, text: str) -> list[str]:
        p = self.prepared(text)
        return self.WORD.findall(p) if self.model.by_word and MARK not in text else [p] if p else []

    def learn(self, words: set[str], group: int = 100) -> None:
        """Encode new words, hold both libraries' results against each other, and
        decode. Words that begin with one space go many to a line: each begins with
        the one token of its own that holds the space. Lines on which anything
        differs are done again word by word."""
        drop = 1 if self.model.prefix else 0  # the reference puts the space back
        fresh = sorted(words)
        one = [w for w in fresh if w[0] == " " and w[1:2] not in ("", " ")] if drop and self.model.by_word else []
        lines = [one[at : at + group] for at in range(0, len(one), group)]
        single = set(fresh).difference(one)
        for lo in range(0, len(lines), 50):  # the library's results are large
            some = lines[lo : lo + 50]
            texts = ["".join(line) for line in some]
            theirs = self.reference.encode([t[1:] for t in texts], num_threads=1)
            for line, text, e, other in zip(some, texts, self.library.encode_batch(texts, add_special_tokens=False), theirs, strict=True):
                own = e.ids
                ids = np.array(own, "<u4")
                at = np.flatnonzero(self.begins[ids]) * 4
                if own == other and len(at) == len(line) and b"".join([self.bytes_of[i] for i in own]) == text.encode():
                    data = ids.tobytes()
                    ends = [*at[1:].tolist(), len(data)]
                    self.known.now.update(zip(line, [data[a:b] for a, b in zip(at.tolist(), ends, strict=True)], strict=True))
                else:
                    single.update(line)
        rest = sorted(single)
        for lo in range(0, len(rest), 4_000):
            part = rest[lo : lo + 4_000]
            ours = [e.ids for e in self.library.encode_batch(part, add_special_tokens=False)]
            theirs = self.reference.encode([w[drop:] for w in part], num_threads=1)
            if drop and " " in part:  # the reference puts no space in front of nothing
                theirs[part.index(" ")] = self.reference.encode("a ")[len(self.reference.encode("a")) :]
            for word, a, b in zip(part, ours, theirs, strict=True):
                self.known.now[word] = array("I", a).tobytes()
                if a != b:
                    self.unlike.add(word)
                if b"".join([self.bytes_of[i] for i in a]) != word.replace(MARK, " ").encode():
                    self.changed.add(word)

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bool, bool]]:
        """Per text: its ids as unsigned 32-bit integers, parity, and whether the
        ids decode to its words."""
        cut = [self.words(t) if t else [] for t in texts]
        self.known.turn()
        every: set[str] = set()
        every.update(*cut)
        if fresh := self.known.miss(every):
            self.learn(fresh)
        take = self.known.now.__getitem__
        out = []
        for words in cut:
            ids = b"".join([*map(take, words)])
            out.append((ids, not self.unlike or self.unlike.isdisjoint(words), not self.changed or self.changed.isdisjoint(words)))
        return out

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        text = b"".join([table[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


@functools.cache
def codec_of(path: str) -> Codec:
    """One codec a model and process."""
    return Codec(path)


forgotten_with(codec_of.cache_clear)


def encode_texts(docs: DataFrame, path: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_ids, ids_crc32, parity, round_trip (decoding
    gives back the text as the model normalises it) and with ``with_ids`` the ids."""
    rows = docs.select(id_col, text_col)
    id_type = rows.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_ids long, ids_crc32 long, parity boolean, round_trip boolean" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        plain = not codec.model.charsmap and not codec.model.squeeze
        for batch in batches:
            columns: list[list] = [[] for _ in range(4 + with_ids)]
            for lo in range(0, batch.num_rows, 256):
                texts = batch.column(1).slice(lo, 256).to_pylist()
                for text, (ids, parity, same) in zip(texts, codec.encode(texts), strict=True):
                    if not plain and text:
                        same = codec.decode(ids) == codec.reference.normalize(text).replace(MARK, " ").removeprefix(" " * codec.model.prefix)
                    values = (len(ids) // 4, zlib.crc32(ids), parity, same)
                    for c, v in zip(columns, (*values, *([array("I", ids).tolist()] if with_ids else [])), strict=True):
                        c.append(v)
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.list_(pa.int64())] * with_ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=[id_col, "n_ids", "ids_crc32", "parity", "round_trip", *["ids"] * with_ids],
            )

    return rows.mapInArrow(frugal(run), schema)


def decode_ids(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of each row's ids; null ids give a null text."""
    rows = rows.select(id_col, ids_col)
    id_type = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            texts = [None if ids is None else codec.decode(array("I", ids).tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return rows.mapInArrow(frugal(run), f"`{id_col}` {id_type}, text string")
