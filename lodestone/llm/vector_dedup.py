"""Near-duplicate vectors by a subspace pigeonhole join.

Two unit vectors with cosine c are 2 - 2c apart in squared distance. A learned
rotation (principal axes of a bounded sample, dealt out so that blocks hold like
variance) is split into blocks, and the squared distance is the sum over blocks: if
it is within the budget, at least one block is within its proportional share. Each
block is range-joined on a grid with borders at the sample's quantiles: a vector has
one home cell and visits every later cell whose box lies within the share's radius,
so each pair within it meets in exactly one cell. How many coordinates a grid cuts,
and how finely, is what costs least by counts on the sample for the number of
vectors at hand: more vectors, more cells. What a block lets through is verified
exactly in double precision on the original vectors, and a pair counts in the first
block that admits it, so the union needs no distinct.

Equal vectors (equal directions are not assumed equal) form one class whose smallest
id stands for it; only classes are joined, weighted by their size. A task returns
one link count for each of its vectors and the edges of a spanning forest of its
links, never all pairs. A crowded cell is cut into chunks and its pairs of chunks are
separate tasks, so no task grows with a cell.

Results for odd input: vectors that are null, zero or hold null or non-finite
components, or whose length is not the commonest, link with nothing and stand for
themselves; an id that repeats counts as one vector if its vectors are equal; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components
from .vectors import matrix, sample_matrix, usable

#: Slack of the filters (not of the exact test) against rounding.
SLACK = 1e-6


def learn_blocks(sample: np.ndarray, count: int) -> list[np.ndarray]:
    """Per block an orthonormal basis (d, width), its widest axis first."""
    d = sample.shape[1]
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    x = x - x.mean(axis=0)
    axes = np.linalg.svd(x.T @ x)[0] if len(x) > 1 else np.eye(d)
    count = min(count, d)
    return [np.ascontiguousarray(axes[:, j::count]) for j in range(count)]


class Forest:
    """Union-find over row numbers, joined by batches of pairs."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            i = self.up[i]
        return int(i)

    def join(self, u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
        """Join each pair; those that were apart until their turn."""
        apart = self.up[u] != self.up[v]
        out = []
        for i, j in zip(u[apart].tolist(), v[apart].tolist(), strict=True):
            a, b = self.root(i), self.root(j)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                out.append((i, j))
        while out and (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return out


#: What a row dealt to a cell costs, in comparisons of two block projections.
ROW_COST = 3_000


class Grid:
    """Cells of one block: per cut coordinate its inner borders, ascending."""

    def __init__(self, borders: list[np.ndarray]):
        self.borders = borders

    def homes(self, x: np.ndarray) -> np.ndarray:
        code = np.zeros(len(x), np.int64)
        for i, b in enumerate(self.borders):
            code = code * (len(b) + 1) + np.searchsorted(b, x[:, i], side="right")
        return code

    def reached(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every cell whose box is within ``radius`` of the row."""
        rows, code, left = np.arange(len(x)), np.zeros(len(x), np.int64), np.full(len(x), radius**2)
        for i, b in enumerate(self.borders):
            at = x[rows, i][:, None]
            gap = np.maximum(np.maximum(np.r_[-np.inf, b] - at, at - np.r_[b, np.inf]), 0.0) ** 2
            r, t = np.nonzero(gap <= left[:, None])
            rows, code, left = rows[r], code[r] * (len(b) + 1) + t, left[r] - gap[r, t]
        return rows, code


def fit_grid(sample: np.ndarray, radius: float, n: int, chunk: int, most_log2: int = 20, draw: int = 1_000) -> Grid:
    """The grid over the sample's coordinates that costs least for ``n`` vectors:
    what is dealt out and what is compared, counted on at most ``draw`` sample rows."""
    width = sample.shape[1]
    best, least = Grid([]), ROW_COST * -(-n // chunk) + n / 2
    for bits in range(1, most_log2 + 1):
        cuts = [1 << (bits // width + (i < bits % width)) for i in range(min(width, bits))]
        grid = Grid([np.quantile(sample[:, i], np.arange(1, k) / k) for i, k in enumerate(cuts)])
        some = sample[: max(100, draw >> max(0, bits - 6))]
        _, reached = grid.reached(some, radius)
        cells, at_home = np.unique(grid.homes(some), return_counts=True)
        where = np.searchsorted(cells, reached)
        inside = cells[np.minimum(where, len(cells) - 1)] == reached
        reaching = np.bincount(where[inside], minlength=len(cells))
        # A vector is compared with the homes of the cells it reaches, half of its own.
        met = (at_home * reaching).sum() / len(some) ** 2
        # Of two cells that reach each other's vectors the later one gets the visit.
        rows = (at_home + (reaching - at_home) / 2) / len(some)
        dealt = (rows * np.ceil(n * rows / chunk)).sum() + (~inside).sum() / 2 / len(some)
        cost = ROW_COST * dealt + n * met / 2
        if cost < least:
            best, least = grid, cost
        elif cost > 3 * least:
            break
    return best


def turned(unit: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``unit @ basis``, summed in the same order whatever the other rows are, so
    that every task that looks at a vector gets the same numbers."""
    out = np.zeros((len(unit), basis.shape[1]))
    for column, row in zip(unit.T, basis, strict=True):
        out += column[:, None] * row[None, :]
    return out


def close_pairs(a: np.ndarray, b: np.ndarray, share: float, same: bool, rows: int = 256, columns: int = 4_096):
    """(i, j) arrays of the pairs within ``share`` in squared distance, and a few
    more (single precision); with ``same`` only i < j."""
    half_a, half_b = (a**2).sum(axis=1) / 2, (b**2).sum(axis=1) / 2
    left = np.hstack([a, -half_a[:, None], np.ones((len(a), 1))]).astype(np.float32)
    right = np.hstack([b, np.ones((len(b), 1)), -half_b[:, None]]).astype(np.float32).T
    for lo in range(0, len(a), rows):
        for at in range(lo if same else 0, len(b), columns):
            # Minus half the squared distance, by one product.
            near = left[lo : lo + rows] @ right[:, at : at + columns] >= np.float32(-share / 2 - 1e-5)
            hits = np.flatnonzero(near)
            if len(hits):
                i, j = np.divmod(hits, near.shape[1])
                i, j = i + lo, j + at
                if same:
                    i, j = i[i < j], j[i < j]
                yield i, j


def near_vectors(vectors: DataFrame, least: float = 0.95, blocks: int = 4, sample: int = 10_000, chunk: int = 16_384, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per distinct id: id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    # Single-precision components stay so where they are stored and dealt out.
    kept_as = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    members = stored(rows.select("id", F.col("v").cast(kept_as).alias("v"), F.xxhash64("v").alias("h")), "vectors")
    # Copies: the class of a vector, by value; the hash only shortens the key.
    classes = stored(members.groupBy("h", "v").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("weight")), "classes")
    n = classes.count()
    id_type = members.schema["id"].dataType.simpleString()
    drawn = sample_matrix(classes.select(F.col("rep").alias("id"), "v"), sample)
    bases = learn_blocks(drawn, blocks) if len(drawn) else []
    budget = 2.0 - 2.0 * least
    d = sum(b.shape[1] for b in bases)
    shares = [budget * b.shape[1] / d for b in bases]
    unit = drawn / np.linalg.norm(drawn, axis=1, keepdims=True) if len(drawn) else drawn
    grids = [fit_grid(unit @ b, np.sqrt(s) + SLACK, n, chunk) for b, s in zip(bases, shares, strict=True)]
    shared = spark.sparkContext.broadcast((bases, shares, grids))

    def place(batches):
        bases, shares, grids = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 1_024):  # a vector may reach many cells
                batch = whole.slice(lo, 1_024)
                x = matrix(batch.column(1))
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                for j, (basis, share, grid) in enumerate(zip(bases, shares, grids, strict=True)):
                    at = unit @ basis
                    home = grid.homes(at)
                    rows, cell = grid.reached(at, np.sqrt(share) + SLACK)
                    later = cell > home[rows]
                    take = pa.array(np.r_[np.arange(len(x)), rows[later]], pa.int64())
                    cell = np.r_[home, cell[later]]
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(i).take(take) for i in range(3)), pa.array(np.full(len(cell), j, np.int32)), pa.array(cell), pa.array(np.arange(len(cell)) < len(x))],
                        names=["rep", "v", "weight", "block", "cell", "home"],
                    )

    schema = f"rep {id_type}, v {kept_as}, weight long, block int, cell long, home boolean"
    placed = classes.select("rep", "v", "weight").mapInArrow(place, schema)
    sizes = placed.groupBy("block", "cell").agg(F.count("*").alias("m"), F.count_if("home").alias("own"))
    sizes = sizes.where("own > 0 and m > 1").select("block", "cell", F.ceil(F.col("m") / chunk).cast("int").alias("k"))
    dealt = placed.join(sizes, ["block", "cell"]).withColumn("x", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least(o, F.col("x")).alias("p"), F.greatest(o, F.col("x")).alias("q")))
    tasks = dealt.withColumn("t", F.explode(others)).select("block", "cell", "t.p", "t.q", "x", "rep", "v", "weight", "home")

    def join(table: pa.Table) -> pa.Table:
        bases, shares, _ = shared.value
        j, p, q = (table[c][0].as_py() for c in ("block", "p", "q"))
        ids, x, w = table["rep"].to_numpy(), matrix(table["v"]), table["weight"].to_numpy()
        home, part = table["home"].to_numpy(zero_copy_only=False).astype(bool), table["x"].to_numpy()
        norm = np.linalg.norm(x, axis=1)
        unit = x / norm[:, None]
        own = turned(unit, bases[j])
        before: list[np.ndarray] = []
        forest, links, found = Forest(len(x)), np.zeros(len(x), np.int64), []
        at = {(c, h): np.flatnonzero((part == c) & (home == h)) for c in (p, q) for h in (True, False)}
        # Two visitors meet in a home of one of them.
        meets = [(at[p, True], at[q, True], p == q), (at[p, True], at[q, False], False)]
        meets += [(at[p, False], at[q, True], False)] if p != q else []
        for a, b, same in meets:
            for s, t in close_pairs(own[a], own[b], shares[j], same):
                if not before:
                    before += [turned(unit, bases[i]) for i in range(j)]
                for lo in range(0, len(s), 65_536):
                    u, v = a[s[lo : lo + 65_536]], b[t[lo : lo + 65_536]]
                    # The first block that admits the pair counts it, so no pair is
                    # counted twice; the last admits what no other does.
                    if j + 1 < len(bases):
                        admits = ((own[u] - own[v]) ** 2).sum(axis=1) <= shares[j]
                        u, v = u[admits], v[admits]
                    for i in range(j):
                        apart = ((before[i][u] - before[i][v]) ** 2).sum(axis=1) > shares[i]
                        u, v = u[apart], v[apart]
                    cosine = np.einsum("ij,ij->i", x[u], x[v]) / (norm[u] * norm[v])
                    u, v = u[cosine >= least], v[cosine >= least]
                    links += np.bincount(u, w[v], len(x)).astype(np.int64) + np.bincount(v, w[u], len(x)).astype(np.int64)
                    found += [(ids[i], ids[k]) for i, k in forest.join(u, v)]
        some = np.flatnonzero(links)
        a = [*ids[some].tolist(), *(i.item() for i, _ in found)]
        b = [None] * len(some) + [i.item() for _, i in found]
        n_links = [*links[some].tolist(), *[0] * len(found)]
        kind = table.schema.field("rep").type
        return pa.table({"a": pa.array(a, kind), "b": pa.array(b, kind), "n": pa.array(n_links, pa.int64())})

    links = stored(tasks.groupBy("block", "cell", "p", "q").applyInArrow(join, f"a {id_type}, b {id_type}, n long"), "links")
    per = links.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    groups = components(links.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    resolved = (
        classes.join(per, "rep", "left").join(groups, "rep", "left")
        .select("h", "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    known = members.join(resolved, ["h", "v"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    everyone = vectors.select(F.col(id_col).alias("id")).distinct()
    out = everyone.join(known, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
