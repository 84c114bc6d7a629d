"""Language identification by word-first backoff.

A word seen in training scores by its log-frequency in each language. An unseen
word is scored by character n-grams of its padded form: by the longest length of
which the model knows at least one. A text's score is the softmax of the summed
log-likelihoods, tempered by the number of words.

The classifier is fitted on at most about ``max_rows`` labelled rows (picked by
the hash of id and text), so what the driver holds and sends out is the vocabulary of
so many rows whatever the corpus is. Every whole text is scored.

Results for odd input: null text and texts without letters give ``und`` with
score 0; without any labelled row every text does; rows with a null language
are not learned from; repeated rows are scored each.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, hash_sample

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
NGRAMS = (5, 4, 3, 2, 1)


def words_of(text: str | None) -> list[str]:
    """Runs of word characters that hold a letter (a raised 2 is none)."""
    found = WORD.findall(text.lower()) if text else []
    return found if all(map(str.isalpha, found)) else [w for w in found if any(map(str.isalpha, w))]


class Model:
    """Per word and per n-gram: a row of a table of log-probabilities by language,
    centred on the languages' mean."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.langs = sorted(counts)
        k = len(self.langs)
        self.words: dict[str, int] = {}
        self.grams: dict[str, int] = {}
        self.word_rows = self.gram_rows = np.zeros((0, k), np.float32)
        if not k:
            return
        self.words, self.word_rows = self._logs([counts[g] for g in self.langs])
        per: list[list[Counter]] = [[Counter() for _ in range(k)] for _ in range(max(NGRAMS) + 1)]
        for j, g in enumerate(self.langs):
            for word, n in counts[g].items():
                padded, weight = f"<{word}>", math.log1p(n)
                for size in NGRAMS:
                    c = per[size][j]
                    for i in range(len(padded) - size + 1):
                        c[padded[i : i + size]] += weight
        tables = []
        for size in NGRAMS:
            index, rows = self._logs(per[size], least=2.0 if size > 3 else 0.0)
            self.grams |= {w: i + sum(map(len, tables)) for w, i in index.items()}
            tables.append(rows)
        self.gram_rows = np.vstack(tables)

    @staticmethod
    def _logs(columns: list[dict], least: float = 0.0) -> tuple[dict[str, int], np.ndarray]:
        totals = np.array([sum(c.values()) for c in columns], float)
        keys = sorted({w for c in columns for w, n in c.items() if n >= least})
        floor = 0.1
        counts = np.array([[c.get(w, 0.0) for c in columns] for w in keys], float).reshape(len(keys), len(columns))
        rows = np.log(counts + floor) - np.log(totals + floor * (len(keys) + 1))
        rows -= rows.mean(axis=1, keepdims=True)
        return {w: i for i, w in enumerate(keys)}, rows.astype(np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "scorer"}

    def vector(self, word: str) -> np.ndarray:
        """Centred log-likelihoods of one word, by language."""
        at = self.words.get(word)
        if at is not None:
            return self.word_rows[at]
        padded, find = f"<{word}>", self.grams.get
        for size in NGRAMS:
            known = [g for i in range(len(padded) - size + 1) if (g := find(padded[i : i + size])) is not None]
            if known:
                return self.gram_rows[known].sum(axis=0) / len(known)
        return np.zeros(len(self.langs), np.float32)


class Scorer:
    """Scores texts; remembers the vectors of some ``remember`` words."""

    def __init__(self, model: Model, remember: int = 120_000):
        self.model, self.remember = model, remember
        self._clear()

    @classmethod
    def of(cls, model: Model) -> Scorer:
        """The one scorer of a process's model, for all its tasks."""
        if not hasattr(model, "scorer"):
            model.scorer = cls(model)
        return model.scorer

    def _clear(self) -> None:
        vector, model = self.model.vector, self.model
        self.rows = np.zeros((1024, len(model.langs)), np.float32)
        scorer = self

        class Index(dict):
            def __missing__(self, word: str) -> int:
                n = len(self)
                if n >= len(scorer.rows):
                    scorer.rows = np.concatenate([scorer.rows, np.zeros_like(scorer.rows)])
                scorer.rows[n] = vector(word)
                self[word] = n
                return n

        self.index = Index()

    def score(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.langs:
            return UNKNOWN, 0.0
        if len(self.index) > self.remember:
            self._clear()
        # Repeated words count, but by the square root of how often they occur.
        counts = Counter(words)
        at = list(map(self.index.__getitem__, counts))
        weight = np.sqrt(np.fromiter(counts.values(), float, len(counts)))
        total = weight @ self.rows[at]
        total = total / math.sqrt(weight.sum())
        best = int(np.argmax(total))
        p = np.exp(total - total[best])
        return self.model.langs[best], float(min(1.0, 1.0 / p.sum()))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 6_000) -> Model:
    """Learn from ``labelled`` (rows with a null language or text are left out)."""
    rows = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("g"))
    rows = hash_sample(rows.where("g is not null and t is not null"), ["i", "t"], max_rows).select("g", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for g, t in zip(batch.column(0), batch.column(1), strict=True):
                seen[g.as_py()].update(words_of(t.as_py()))
            flat = [(g, w, n) for g, c in seen.items() for w, n in c.items()]
            g, w, n = zip(*flat, strict=True) if flat else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(g, pa.string()), pa.array(w, pa.string()), pa.array(n, pa.int64())], names=["g", "w", "n"]
            )

    counted = rows.mapInArrow(frugal(count), "g string, w string, n long").groupBy("g", "w").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for g, w, n in counted.toPandas().itertuples(index=False):  # the words of the sampled rows
        counts[g][w] = int(n)
    return Model(dict(counts))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score (0 to 1)."""
    rows = docs.select(id_col, text_col)
    id_type = rows.schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer.of(shared.value)
        for batch in batches:
            got = [scorer.score(t) for lo in range(0, batch.num_rows, 256) for t in batch.column(1).slice(lo, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g for g, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())],
                names=[id_col, "lang_pred", "score"],
            )

    return rows.mapInArrow(frugal(run), f"`{id_col}` {id_type}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, whose language is identified; ``und`` goes."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer.of(shared.value)
        for batch in batches:
            keep = [scorer.score(t)[0] != UNKNOWN for lo in range(0, batch.num_rows, 256) for t in batch.column(at).slice(lo, 256).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)
