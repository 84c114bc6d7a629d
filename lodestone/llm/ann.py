"""Approximate nearest neighbours by multi-index hashing.

*Codes.* Rotations learned on a bounded sample (iterative quantisation: alternate
the signs of the rotated sample and the orthogonal Procrustes solution) turn a
vector into ``rotations * dimension`` bits.

*Index.* A code is split into substrings of sixteen bits, about the logarithm of a
block. Every block of the corpus keeps, per substring and value, the list of its codes.
A query with Hamming radius R over m substrings probes each substring's values within
R // m bits: by the pigeonhole principle every code within R lies in at least one
probed list. The union's codes within R are kept and their float vectors reranked by
inner product in double precision. Where so many values are near that their lists are
expected to hold a block over, the block's codes are compared directly: the same codes
are within R.

*Radius.* It is set so that ``recall`` of the exact neighbours of a bounded set of
probe queries lie within it; those are found by one exact pass over all rows. A
query that finds fewer than k codes within R reranks the whole block, so no query
comes short.

*Blocks.* A row is dealt once, to its block. The queries are written once to the shared
folder, and a block's task reads them there batch by batch, so what is shuffled grows
with the rows and the results (k a block and query), and neither side is broadcast or
gathered. Every row is indexed; the sample only fits rotations.

Results for odd input: vectors that are null, zero or hold null or non-finite
components neither ask nor answer; if lengths differ, the commonest takes part; ties go
to the smaller id; fewer candidates than k are all returned; an id that repeats stands
with its smallest vector; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_dir, hash_sample, read_batches, stored
from .vectors import matrix, sample_matrix, usable

SUB = 16  # bits of a substring
#: Every mask of a substring, by the number of its bits, and how many have at most r.
MASKS = np.argsort(np.bitwise_count(np.arange(1 << SUB, dtype=np.uint32)), kind="stable").astype(np.uint16)
WITHIN = np.cumsum(np.bincount(np.bitwise_count(np.arange(1 << SUB, dtype=np.uint32)), minlength=SUB + 1))


def learn_rotations(sample: np.ndarray, count: int, rounds: int = 25, seed: int = 7) -> np.ndarray:
    """``count`` learned rotations, stacked: (count * d, d)."""
    d = sample.shape[1]
    rng = np.random.default_rng(seed)
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    out = []
    for _ in range(count):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds if len(x) > d else 0):
            b = np.where(x @ r > 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(b.T @ x)
            r = (u @ w).T
        out.append(r.T)
    return np.vstack(out)


def encode(x: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Codes as bytes, one row a vector; padded with zero bits to whole words."""
    codes = np.packbits(x @ rotations.T > 0, axis=1)
    return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))))


def hamming(codes: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ one[None, :]).sum(axis=1, dtype=np.int32)


class Block:
    """The index over one block of the corpus: per substring the order of its
    values and where each value's list begins."""

    def __init__(self, codes: np.ndarray):
        self.words, self.subs = codes.view(np.uint64), codes.view(np.uint16)
        self.order: list[np.ndarray] = []
        self.begin: list[np.ndarray] = []

    def _index(self) -> None:
        for j in range(self.subs.shape[1]):
            self.order.append(np.argsort(self.subs[:, j], kind="stable"))
            self.begin.append(np.r_[0, np.cumsum(np.bincount(self.subs[:, j], minlength=1 << SUB))])

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray | None:
        """Row numbers in a probed list; None where the lists would hold a block over."""
        own = code.view(np.uint16)
        per = radius // len(own)
        near = int(WITHIN[min(per, SUB)])
        if near * len(own) >= 1 << SUB:
            return None
        if not self.order:
            self._index()
        hit = np.zeros(len(self.subs), bool)
        for value, order, begin in zip(own, self.order, self.begin, strict=True):
            values = (value ^ MASKS[:near]).astype(np.int64)
            first, last = begin[values], begin[values + 1]
            for a, b in zip(first[last > first].tolist(), last[last > first].tolist(), strict=True):
                hit[order[a:b]] = True
        return np.flatnonzero(hit)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Row numbers of every code within ``radius`` of ``code``."""
        at = self.probed(code, radius)
        words, own = (self.words if at is None else self.words[at]), code.view(np.uint64)
        near = np.bitwise_count(words ^ own[None, :]).sum(axis=1, dtype=np.int32) <= radius
        return np.flatnonzero(near) if at is None else at[near]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by score, then by smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= edge)
        return keep[np.lexsort((ids[keep], -scores[keep]))][:k]
    return np.lexsort((ids, -scores))[:k]


def inner(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row-wise inner products; one order of summation whatever the row count."""
    return np.einsum("ij,j->i", vectors, q, optimize=False)


def _exact_probes(rows: DataFrame, ids: np.ndarray, probes: np.ndarray, k: int) -> dict[int, list[np.ndarray]]:
    """The k nearest vectors of each of a bounded set of probes, by one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, v = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
            s = v @ probes.T
            p, i, x = [], [], []
            for j in range(len(probes)):
                scores = np.where(own == ids[j], -np.inf, s[:, j])
                for at in best(own, scores, k):
                    if own[at] != ids[j]:
                        p.append(j), i.append(scores[at]), x.append(v[at])
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(i, pa.float64()), pa.array(x, pa.list_(pa.float64()))], names=["p", "s", "v"])

    found = rows.mapInArrow(run, "p int, s double, v array<double>")
    top = Window.partitionBy("p").orderBy(F.desc("s"))
    found = found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).select("p", "v").toArrow()
    out: dict[int, list[np.ndarray]] = {}
    for p, v in zip(found["p"].to_pylist(), found["v"].to_pylist(), strict=True):
        out.setdefault(p, []).append(np.array(v))
    return out


def fit_radius(rows: DataFrame, rotations: np.ndarray, k: int, probes: int = 64, recall: float = 0.97) -> int:
    """The Hamming radius that holds ``recall`` of the probes' exact neighbours."""
    got = hash_sample(rows, ["id"], probes).toArrow()
    ids, x = np.array(got["id"].to_pylist()), matrix(got["v"])
    if not len(x):
        return 0
    far = [
        hamming(encode(np.array(near), rotations), encode(x[j : j + 1], rotations)[0])
        for j, near in _exact_probes(rows, ids, x, k).items()
    ]
    return int(np.quantile(np.concatenate(far), recall, method="higher")) if far else 0


def nearest(vectors: DataFrame, asks: Column, k: int = 20, rotations: int = 4, sample: int = 10_000, block: int = 32_768, query_block: int = 1_024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query.
    ``asks`` is a predicate on the column ``id``; a query's own id is no candidate.
    ``sample`` bounds the rows that the rotations are fitted on."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    n = rows.count()
    drawn = sample_matrix(rows, sample)
    turned = learn_rotations(drawn, rotations) if len(drawn) else np.zeros((0, 0))
    radius = fit_radius(rows, turned, k)
    folder = fresh_dir(spark, "queries")
    rows.where(asks).select("id", "v").write.parquet(folder)
    nb = max(1, -(-n // block))
    id_type = rows.schema["id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast((turned, radius))  # d * d * rotations numbers

    def answers(own: np.ndarray, x: np.ndarray, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        turn, reach = shared.value
        index = Block(encode(x, turn))
        for some in read_batches(folder, query_block):
            out: list[tuple] = []
            v = matrix(some.column(1))
            for query, q, code in zip(some.column(0).to_pylist(), v, encode(v, turn), strict=True):
                at = index.within(code, reach)
                at = at[own[at] != query]
                if len(at) < k:
                    at = np.flatnonzero(own != query)
                scores = inner(x[at], q)
                out += [(query, own[at[j]], scores[j]) for j in best(own[at], scores, k)]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], kind), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # one block
        at, kind = None, pa.int64()

        def done() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            return answers(table["id"].to_numpy(), matrix(table["v"]), kind)

        for batch in batches:
            kind = batch.schema.field(0).type
            b = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if held and b[lo] != at:
                    yield from done()
                    held = []
                at = b[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from done()

    dealt = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int").alias("b")).repartition(nb, "b").sortWithinPartitions("b")
    found = dealt.mapInArrow(run, f"query_id {id_type}, vec_id {id_type}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id"), "score")
