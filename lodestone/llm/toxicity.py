"""Toxicity by a weighted finite-state pattern grammar.

Transducers are data: states and arcs (input, output, weight, next). A clause is read
by the composition of

1. the *lexicon*, word -> symbols and weights: a word may be an INSULT or a THREAT,
   weighted, or be passed over as an ordinary word; others are TARGET, NEGATION,
   REPORT, OPEN, CLOSE (a quotation's marks) or OTHER. The insults and their weights
   are learned: words and word stems whose labelled-document log-odds are high in
   varied surroundings; the small lists below seed the rest;
2. *negation*: a hit at most two words after a NEGATION is a negated one;
3. *reported speech*: other hits after a REPORT in the clause or inside a quotation
   are reported ones;
4. *target*: an insult in a clause with a TARGET, before or after it, is a targeted
   one, and a threat needs one; the machine guesses at the hit and must be right;
5. the union of *insult* and *threat*, which accept a clause with one hit.

A clause's readings are the largest weights of the accepting paths, by kind; a
document's features are the kinds' counts and peaks, and a logistic arc weighting
fitted on the same labelled rows turns them into a score. Words outside a matched
clause never score. Quotation marks count in pairs inside a line; a mark that pairs
with none, such as an inch mark, is no quotation.

Learning uses at most about ``max_rows`` labelled rows (by the hash of id and text), a
documented bound; scoring reads every whole text.

Results for odd input: null and empty texts score as texts without a hit; labels
other than 0 and 1 are not learned from; with no labels of one class no insult is
learned and every score is 0; repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, hash_sample, stored

TOKEN = re.compile(r"[^\W_]+|[.!?;\n]+|[\x02\x03]")
MARKS = re.compile("[\"«»“”„\n]")

# Closed word classes of the grammar, in the languages at hand.
NEGATIONS = frozenset("not never no none nor without nicht kein keine nie pas jamais aucun nunca sin ningún".split())
TARGETS = frozenset("you your he she they him her them we us du ihr er sie euch dich tu vous il elle ils lui toi usted ustedes él ella ellos te".split())
REPORTS = frozenset("said says say wrote writes quoted called claimed told sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())
THREATS = frozenset("kill hurt destroy murder burn beat shoot stab töten schlagen tuer frapper matar golpear".split())
CLOSED_BY = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«"}

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, OPEN, CLOSE, BREAK = range(9)
#: Symbols between the machines.
NEGATED, NO_THREAT, REPORTED, TARGETED, TARGETED_THREAT = range(9, 14)
TAPES = ("plain", "targeted", "negated", "reported", "threat")
STEMS = (4, 5, 6, 7)


def paired(text: str) -> str:
    """``text`` with the marks that open a quotation as U+0002, those that close it as
    U+0003. A quotation ends in its line; a straight mark after a letter or digit
    opens none."""
    out, at = [], 0
    opened: list[tuple[int, str]] = []
    for m in MARKS.finditer(text):
        i, mark = m.start(), m[0]
        if mark == "\n":
            opened = []
        elif opened and mark in CLOSED_BY[opened[0][1]]:
            j = opened[0][0]
            out += [text[at:j], "\x02", text[j + 1 : i], "\x03"]
            at, opened = i + 1, []
        elif not opened and mark in CLOSED_BY and not (mark == '"' and i and text[i - 1].isalnum()):
            opened = [(i, mark)]
    return "".join([*out, text[at:]])


def tokens(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    if "\x02" in text or "\x03" in text:
        text = text.replace("\x02", " ").replace("\x03", " ")
    return TOKEN.findall(paired(text) if MARKS.search(text) else text)


Reading = tuple[tuple[int, float], ...]


class Lexicon(dict):
    """word -> its (symbol, weight) alternatives: the first transducer, as a memo
    that fills itself. ``words`` and ``stems`` map learned insults to their weights."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], remember: int = 120_000):
        super().__init__()
        self.words, self.stems, self.remember = words, stems, remember

    def __missing__(self, token: str) -> Reading:
        if len(self) >= self.remember:
            self.clear()
        self[token] = got = self._read(token)
        return got

    def _read(self, token: str) -> Reading:
        if not token[0].isalnum():
            return (({"\x02": OPEN, "\x03": CLOSE}.get(token, BREAK), 0.0),)
        plain = OTHER
        for symbol, members in ((NEGATION, NEGATIONS), (TARGET, TARGETS), (REPORT, REPORTS)):
            if token in members:
                plain = symbol
        weight = max(
            [self.words.get(token, 0.0), *(self.stems.get(token[:n], 0.0) for n in STEMS if len(token) > n)]
        )
        hits = ((INSULT, weight),) if weight > 0 else ((THREAT, 1.0),) if token in THREATS else ()
        return (*hits, (plain, 0.0))


class Transducer:
    """A weighted finite-state transducer. ``arcs[state][input]`` lists (output,
    weight, next); ``finals`` maps accepting states to a label or None."""

    def __init__(self, start, arcs: dict, finals: dict):
        self.start, self.arcs, self.finals = start, arcs, finals

    def numbered(self) -> Transducer:
        """The same machine, states as numbers, without those that reach no end."""
        alive, more = set(self.finals), True
        while more:
            found = {s for s, by in self.arcs.items() if s not in alive and any(n in alive for arcs in by.values() for _, _, n in arcs)}
            alive, more = alive | found, bool(found)
        at = {s: i for i, s in enumerate([self.start, *(s for s in self.arcs if s in alive and s != self.start)])}
        arcs = {
            i: {x: kept for x, found in self.arcs.get(s, {}).items() if (kept := [(y, w, at[n]) for y, w, n in found if n in at])}
            for s, i in at.items()
        }
        return Transducer(0, arcs, {at[s]: label for s, label in self.finals.items() if s in at})


def compose(first: Transducer, second: Transducer) -> Transducer:
    """What ``first`` writes is read by ``second``; weights add up. A final state's
    label is the second's, or the first's where that is None."""
    start = (first.start, second.start)
    arcs: dict = {}
    finals: dict = {}
    waiting = [start]
    while waiting:
        state = p, q = waiting.pop()
        if state in arcs:
            continue
        arcs[state] = by = {}
        if p in first.finals and q in second.finals:
            label = second.finals[q]
            finals[state] = first.finals[p] if label is None else label
        for x, found in first.arcs.get(p, {}).items():
            for y, w, n in found:
                for z, v, m in second.arcs.get(q, {}).get(y, ()):
                    by.setdefault(x, []).append((z, w + v, (n, m)))
                    waiting.append((n, m))
    return Transducer(start, arcs, finals).numbered()


def union(first: Transducer, second: Transducer) -> Transducer:
    """Accepts what either accepts."""
    arcs: dict = {}
    finals: dict = {}
    for i, machine in enumerate((first, second)):
        for s, by in machine.arcs.items():
            arcs[i, s] = {x: [(y, w, (i, n)) for y, w, n in found] for x, found in by.items()}
        finals |= {(i, s): label for s, label in machine.finals.items()}
    arcs["start"] = {}
    for i, machine in enumerate((first, second)):
        for x, found in arcs[i, machine.start].items():
            arcs["start"][x] = arcs["start"].get(x, []) + found
        if machine.start in machine.finals:
            finals["start"] = machine.finals[machine.start]
    return Transducer("start", arcs, finals)


def best(machine: Transducer, clause: list[Reading]) -> dict[str, float]:
    """label -> the largest weight of a path that reads the clause and ends there."""
    now = {machine.start: 0.0}
    for alternatives in clause:
        then: dict = {}
        for state, total in now.items():
            arcs = machine.arcs[state]
            for symbol, weight in alternatives:
                for _, w, n in arcs.get(symbol, ()):
                    if total + weight + w > then.get(n, -np.inf):
                        then[n] = total + weight + w
        now = then
    out: dict[str, float] = {}
    for state, total in now.items():
        if state in machine.finals:
            label = machine.finals[state]
            out[label] = max(total, out.get(label, -np.inf))
    return out


def _same(*symbols: int, to) -> dict:
    return {x: [(x, 0.0, to)] for x in symbols}


def negation() -> Transducer:
    """States: how many words ago the negation was (0: none near)."""
    arcs = {}
    for state, after in ((0, 0), (1, 2), (2, 0)):
        arcs[state] = _same(OTHER, TARGET, REPORT, to=after) | _same(OPEN, CLOSE, to=state) | {NEGATION: [(OTHER, 0.0, 1)]}
        hits = {INSULT: NEGATED, THREAT: NO_THREAT} if state else {INSULT: INSULT, THREAT: THREAT}
        arcs[state] |= {x: [(y, 0.0, after)] for x, y in hits.items()}
    return Transducer(0, arcs, dict.fromkeys(arcs))


def reported_speech() -> Transducer:
    """States: whether a verb of saying came, and whether a quotation is open."""
    arcs = {}
    for said in (False, True):
        for quoted in (False, True):
            here = (said, quoted)
            arcs[here] = _same(OTHER, TARGET, NEGATED, NO_THREAT, to=here)
            arcs[here] |= {REPORT: [(OTHER, 0.0, (True, quoted))], OPEN: [(OTHER, 0.0, (said, True))], CLOSE: [(OTHER, 0.0, (said, False))]}
            arcs[here] |= {x: [(REPORTED if said or quoted else x, 0.0, here)] for x in (INSULT, THREAT)}
    return Transducer((False, False), arcs, dict.fromkeys(arcs))


def target() -> Transducer:
    """States: none yet, seen, promised for later, promised to stay away."""
    rest = (OTHER, NEGATED, NO_THREAT, REPORTED)
    arcs = {s: _same(*rest, to=s) for s in ("none", "seen", "promised", "away")}
    for state, then in (("none", "seen"), ("seen", "seen"), ("promised", "seen")):
        arcs[state][TARGET] = [(OTHER, 0.0, then)]
    arcs["none"] |= {INSULT: [(INSULT, 0.0, "away"), (TARGETED, 0.0, "promised")], THREAT: [(TARGETED_THREAT, 0.0, "promised")]}
    arcs["seen"] |= {INSULT: [(TARGETED, 0.0, "seen")], THREAT: [(TARGETED_THREAT, 0.0, "seen")]}
    return Transducer("none", arcs, {"none": None, "seen": None, "away": None})


def one_hit(kinds: dict[int, str]) -> Transducer:
    """Accepts a clause with one hit of ``kinds``, labelled by its kind."""
    arcs = {"before": _same(OTHER, to="before")} | {label: _same(OTHER, to=label) for label in kinds.values()}
    for symbol, label in kinds.items():
        arcs["before"][symbol] = [(symbol, 0.0, label)]
    return Transducer("before", arcs, {label: label for label in kinds.values()})


def insult() -> Transducer:
    return one_hit({INSULT: "plain", TARGETED: "targeted", NEGATED: "negated", REPORTED: "reported"})


def threat() -> Transducer:
    return one_hit({TARGETED_THREAT: "threat"})


def grammar() -> Transducer:
    return compose(compose(compose(negation(), reported_speech()), target()), union(insult(), threat()))


GRAMMAR = grammar()
_OTHER: Reading = ((OTHER, 0.0),)


def clause_readings(symbols: list[Reading]) -> list[tuple[int, float]]:
    """One (tape, weight) for each reading of each of a text's clauses. A clause
    inside a quotation begins with its mark; without a hit it has no reading."""
    out: list[tuple[int, float]] = []
    clause: list[Reading] = []
    quoted = hit = False
    for reading in [*symbols, ((BREAK, 0.0),)]:
        symbol = reading[-1][0]
        if symbol == BREAK:
            if hit:
                out += [(TAPES.index(label), w) for label, w in best(GRAMMAR, clause).items()]
            clause, hit = [((OPEN, 0.0),)] if quoted else [], False
            continue
        if symbol == OPEN or symbol == CLOSE:
            quoted = symbol == OPEN
        elif len(reading) > 1:
            hit = True
        elif reading == _OTHER and len(clause) > 1 and clause[-1] == clause[-2] == _OTHER:
            continue  # after two ordinary words a third changes no state
        clause.append(reading)
    return out


def features(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """Per tape: log(1 + clauses) and the peak weight."""
    x = np.zeros(2 * len(TAPES))
    symbols = [lexicon[t] for t in tokens(text)]
    if not symbols or max(map(len, symbols)) < 2:
        return x
    for tape, w in clause_readings(symbols):
        x[2 * tape] += 1
        x[2 * tape + 1] = max(x[2 * tape + 1], w)
    x[::2] = np.log1p(x[::2])
    return x


class Model:
    def __init__(self, words: dict[str, float], stems: dict[str, float], weights: np.ndarray, bias: float):
        self.words, self.stems, self.weights, self.bias = words, stems, weights, bias

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "memo"}

    def lexicon(self) -> Lexicon:
        """The one lexicon of a process's model, for all its tasks."""
        if not hasattr(self, "memo"):
            self.memo = Lexicon(self.words, self.stems)
        return self.memo

    def score(self, text: str | None, lexicon: Lexicon) -> float:
        z = float(features(text, lexicon) @ self.weights) + self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))))


def _evidence(rows: DataFrame) -> DataFrame:
    """w, toxic and clean documents that hold the word, and a bitmap of hashed
    left neighbours in toxic ones (near copies of one text share them)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in ((t.as_py(), y.as_py()) for t, y in zip(batch.column(0), batch.column(1), strict=True)):
                own: dict[str, int] = {}
                before = ""
                for t in tokens(text):
                    if t[0].isalnum():
                        own[t] = own.get(t, 0) | 1 << (sum(before.encode()) * 31 + len(before)) % 61
                    before = t
                for t, bits in own.items():
                    entry = seen.setdefault(t, [0, 0, 0])
                    if toxic:
                        entry[0] += 1
                        entry[2] |= bits
                    else:
                        entry[1] += 1
            values = list(zip(*seen.values(), strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), *(pa.array(v, pa.int64()) for v in values)],
                names=["w", "n_toxic", "n_clean", "around"],
            )

    sums = [F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"), F.bit_or("around").alias("around")]
    words = rows.mapInArrow(frugal(count), "w string, n_toxic long, n_clean long, around long").groupBy("w").agg(*sums)
    whole = words.select("w", F.lit(0).alias("stem"), "n_toxic", "n_clean", "around")
    cut = words.select(
        F.explode(F.array(*[F.struct(F.substring("w", 1, n).alias("w"), F.lit(n).alias("stem")) for n in STEMS])).alias("p"),
        "w", "n_toxic", "n_clean", "around",
    ).where(F.length("w") > F.col("p.stem"))
    stems = cut.groupBy(F.col("p.w").alias("w"), F.col("p.stem").alias("stem")).agg(*sums, F.count("*").alias("forms"))
    stems = stems.where("forms >= 3").drop("forms")
    return whole.unionByName(stems)


def fit(labelled: DataFrame, text_col: str = "text", toxic_col: str = "toxic", id_col: str = "doc_id", max_rows: int = 12_000, least_docs: int = 4, least_around: int = 4, least_odds: float = 3.0) -> Model:
    """Learn the lexicon and the arc weights from rows of (id, text, toxic)."""
    known = labelled.where(F.col(toxic_col).isin(0, 1) & F.col(text_col).isNotNull())
    rows = known.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), (F.col(toxic_col) == 1).alias("y"))
    rows = stored(hash_sample(rows, ["i", "t"], max_rows).select("t", "y"), "labelled")  # read five times
    totals = rows.agg(F.count_if("y").alias("a"), F.count_if(~F.col("y")).alias("b")).first()
    n_toxic, n_clean = totals["a"], totals["b"]
    none = Model({}, {}, np.zeros(2 * len(TAPES)), -40.0)
    if not n_toxic or not n_clean:
        return none
    odds = F.log((F.col("n_toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("n_clean") + 0.5) / (n_clean + 1.0))
    entries = (
        _evidence(rows)
        .where((F.col("n_toxic") >= least_docs) & (F.bit_count("around") >= least_around))
        .withColumn("odds", odds)
        .where(F.col("odds") >= least_odds)
        .where(F.col("n_clean") <= F.col("n_toxic") / 10)
        .select("w", "stem", "odds")
        .toPandas()  # words of the sampled rows
    )
    words = {w: o for w, s, o in entries.itertuples(index=False) if s == 0}
    stems = {w: o for w, s, o in entries.itertuples(index=False) if s > 0}
    model = Model(words, stems, np.zeros(2 * len(TAPES)), 0.0)
    shared = labelled.sparkSession.sparkContext.broadcast(model)
    width = 2 * len(TAPES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value.lexicon()
        for batch in batches:
            x = [features(t.as_py(), lexicon).tolist() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    seen = rows.mapInArrow(frugal(read), "x array<double>, y boolean").groupBy("x", "y").count().toPandas()  # at most max_rows
    x = np.array(seen["x"].tolist(), float).reshape(-1, width)
    y, n = seen["y"].to_numpy(float), seen["count"].to_numpy(float)
    model.weights, model.bias = logistic(x, y, n)
    return model


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Weighted ridge logistic regression by Newton steps; each class weighs half,
    and the tapes' weights stay at or above zero (a hit never lowers a score)."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = n * np.where(y == 1, 0.5 / max(n[y == 1].sum(), 1e-9), 0.5 / max(n[y == 0].sum(), 1e-9)) * min(n.sum(), 2000)
    keep = np.diag([ridge] * x.shape[1] + [1e-6])
    theta = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -40, 40)))
        step = np.linalg.solve(a.T @ (a * (w * p * (1 - p))[:, None]) + keep + 1e-9 * np.eye(len(theta)), a.T @ (w * (y - p)) - keep @ theta)
        theta = theta + step
        theta[:-1] = np.maximum(theta[:-1], 0.0)
        if np.abs(step).max() < 1e-8:
            break
    return theta[:-1], float(theta[-1])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and score."""
    rows = docs.select(id_col, text_col)
    id_type = rows.schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        lexicon = m.lexicon()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([m.score(t.as_py(), lexicon) for t in batch.column(1)], pa.float64())],
                names=[id_col, "score"],
            )

    return rows.mapInArrow(frugal(run), f"`{id_col}` {id_type}, score double")


def keep_civil(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, unchanged, that score below ``threshold``."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        lexicon = m.lexicon()
        for batch in batches:
            keep = [m.score(t.as_py(), lexicon) < threshold for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)
