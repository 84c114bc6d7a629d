import gzip
import hashlib
import io
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import ann, near_dedup, vector_dedup, warc
from lodestone.llm.components import components

# ---- components --------------------------------------------------------------------


def union(edges):
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in up}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 3), (5, 4)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)]])
def test_components(spark, edges):
    got = components(spark.createDataFrame(edges, "a long, b long"))
    want = {k: v for k, v in union(edges).items() if any(k in e and e[0] != e[1] for e in edges)}
    assert {r.node: r.component for r in got.collect()} == want


# ---- vectors -----------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def vector_rows(n=400, d=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    for i in range(0, n - 5, 9):
        x[i + 1] = x[i] + rng.standard_normal(d) * 0.1
        x[i + 2] = x[i]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x.astype(np.float32))]
    bad = [(n, None, 0), (n + 1, [0.0] * d, 0), (n + 2, [float("nan")] * d, 0), (n + 3, [1.0] * (d - 1) + [None], 0), (n + 4, [1.0], 0)]
    return rows, bad


def test_nearest_neighbours_recall_and_shape(spark):
    rows, bad = vector_rows()
    got = ann.nearest(vectors(spark, rows + bad), F.col("id") % 20 == 0, k=5, rotations=8, block=150, query_block=7).collect()
    x, ids = np.array([r[1] for r in rows], float), [r[0] for r in rows]
    per = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        per.setdefault(r.query_id, []).append(r)
    assert set(per) == set(range(0, 400, 20))
    hits = 0
    for q, rs in per.items():
        assert [r["rank"] for r in rs] == [1, 2, 3, 4, 5] and all(r.vec_id != q for r in rs)
        assert all(abs(r.score - x[r.vec_id] @ x[q]) < 1e-9 for r in rs)
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)
        best = sorted((-(x[i] @ x[q]), i) for i in ids if i != q)[:5]
        hits += len({i for _, i in best} & {r.vec_id for r in rs})
    assert hits / (5 * len(per)) >= 0.9


def test_index_returns_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (3_000, 8), dtype=np.uint8)
    codes[1:300] = codes[0] ^ (1 << rng.integers(0, 8, (299, 8))).astype(np.uint8) * (rng.random((299, 8)) < 0.4)
    block = ann.Block(codes)
    fewer = 0
    for radius in (0, 3, 4, 7, 8, 11, 13, 32, 64):
        for q in codes[:20]:
            near = np.flatnonzero(ann.hamming(codes, q) <= radius)
            assert set(block.within(q, radius)) == set(near)
            if (at := block.probed(q, radius)) is not None:
                assert set(near) <= set(at)
                fewer += len(at) < 600
    assert fewer > 60


def test_ties_go_to_the_smaller_id_and_columns_may_clash(spark):
    rows = [(0, [1.0, 0.0], 0)] + [(i, [1.0, float(i % 2)], 0) for i in range(1, 40) if i != 20]
    d = vectors(spark, rows).selectExpr("*", "1 AS id", "2 AS v", "3 AS score", "4 AS rank", "5 AS query_id", "6 AS b", "7 AS asks")
    got = sorted((r["rank"], r.vec_id, r.score) for r in ann.nearest(d, F.col("id") % 20 == 0, k=5).collect())
    assert got == [(i + 1, v, 1.0) for i, v in enumerate([1, 2, 3, 4, 5])]
    d = vectors(spark, rows).selectExpr("*", "1 AS id", "2 AS v", "3 AS h", "4 AS rep", "5 AS weight", "6 AS block", "7 AS cell", "8 AS kept", "9 AS component_id", "10 AS n_links")
    found = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_vectors(d).collect()}
    assert found[0] == found[2] == (18, 0) and found[1] == (19, 1)


def test_few_vectors_and_none(spark):
    rows, bad = vector_rows(3)
    got = ann.nearest(vectors(spark, rows + bad), F.col("id") % 20 == 0, k=5).collect()
    assert sorted(r.vec_id for r in got) == [1, 2]
    assert ann.nearest(vectors(spark, bad[:3]), F.col("id") % 20 == 0).count() == 0
    assert ann.nearest(vectors(spark, []), F.col("id") % 20 == 0).count() == 0


def test_grids_meet_every_pair_once():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 6)) * 0.1
    radius = 0.12
    for cuts in ([], [2], [2, 2, 2], [4, 4], [8, 2, 2, 2, 2, 2]):
        grid = vector_dedup.Grid([np.quantile(x[:, i], np.arange(1, k) / k) for i, k in enumerate(cuts)])
        home, (rows, cells) = grid.homes(x), grid.reached(x, radius)
        reach = {(int(r), int(c)) for r, c in zip(rows, cells, strict=True)}
        assert all((i, int(c)) in reach for i, c in enumerate(home))
        for i, j in zip(*np.nonzero(((x[:, None] - x[None]) ** 2).sum(axis=2) <= radius**2), strict=True):
            late, early = (i, j) if home[i] > home[j] else (j, i)
            assert (int(early), int(home[late])) in reach  # the earlier one visits the later home
    assert len(vector_dedup.fit_grid(x, radius, 300, 1_000).borders) == 0
    assert vector_dedup.fit_grid(rng.standard_normal((2_000, 6)), 0.12, 10_000_000, 1_000).borders


def test_close_pairs_hold_all_within_the_share():
    rng = np.random.default_rng(6)
    a, b = rng.standard_normal((700, 5)) * 0.2, rng.standard_normal((900, 5)) * 0.2
    found = {(int(i), int(j)) for s, t in vector_dedup.close_pairs(a, b, 0.1, False, 100, 128) for i, j in zip(s, t, strict=True)}
    near = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    assert found >= {(int(i), int(j)) for i, j in zip(*np.nonzero(near <= 0.1), strict=True)} and all(near[i, j] <= 0.1001 for i, j in found)
    own = [(int(i), int(j)) for s, t in vector_dedup.close_pairs(a, a, 0.1, True, 100, 128) for i, j in zip(s, t, strict=True)]
    assert len(own) == len(set(own)) and all(i < j for i, j in own)


@pytest.mark.parametrize("chunk", [8192, 20])
def test_vector_near_dedup_equals_brute_force(spark, chunk):
    rows, bad = vector_rows()
    rows += [(1000 + i, rows[0][1], 0) for i in range(40)]  # a hot vector
    got = {r.vec_id: r for r in vector_dedup.near_vectors(vectors(spark, rows + bad), chunk=chunk).collect()}
    x, ids = np.array([r[1] for r in rows], float), [r[0] for r in rows]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    comp = union([(ids[i], ids[j]) for i, j in zip(*np.nonzero(near), strict=True)])
    for i, n in zip(ids, near.sum(axis=1) - 1, strict=True):
        assert got[i].n_links == n and got[i].component_id == comp[i] and got[i].kept == (comp[i] == i)
    for i, *_ in bad:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert vector_dedup.near_vectors(vectors(spark, [])).count() == 0


# ---- text near-dedup ---------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = text.lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def near_rows(seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts = []
    for _ in range(30):
        base = [word() for _ in range(rng.randint(60, 200))]
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        texts.append(" ".join(base[:30] + [word() for _ in range(100)]))  # shares a passage only
    texts += [None, "", " ", "one two", "one two", "ONE two", "one three", "x " * 3000, "x " * 3000]
    return [(i, t, "en", "s", 1) for i, t in enumerate(texts)]


def test_near_dedup_equals_brute_force(spark):
    rows = near_rows()
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    sets = {i: shingles(t or "") for i, t, *_ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    comp = union(links)
    for i, *_ in rows:
        assert got[i].component_id == comp.get(i, i) and got[i].kept == (comp.get(i, i) == i)
    kept = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_near_dedup_empty_and_repeated_rows(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "a b c d e f", None, None, None)] * 2 + [(2, "a b c d e f", None, None, None)]
    assert sorted((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()) == [(1, 1), (1, 1), (2, 1)]


def test_near_dedup_ids_that_repeat_and_clashing_columns(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (2, b), (5, a), (5, a), (5, b), (7, None), (7, None), (None, a), (8, "only this one"), (8, "only this one")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS id", "1 AS component", "2 AS th", "3 AS _gone", "4 AS n", "5 AS kept", "6 AS t")
    got = near_dedup.near_duplicates(d).collect()
    assert len(got) == len(rows)
    per = {r.doc_id: r.component_id for r in got}
    assert per[5] in (1, 2) and per[1] == 1 and per[2] == 2 and per[7] == 7 and per[None] is None
    kept = near_dedup.drop_near_duplicates(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, a), (1, a), (2, b), (7, ""), (8, "only this one")]


@pytest.mark.parametrize("rows", [1_000, 7])
def test_crowded_bands_in_small_blocks_equal_brute_force(spark, rows, monkeypatch):
    """Near copies of one text whose pairs are partly under the least similarity."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(40):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    plain = near_dedup._blocks
    monkeypatch.setattr(near_dedup, "_blocks", lambda members, block_rows, block_bytes: plain(members, rows, block_bytes))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [shingles(t) for t in texts]
    comp = union([(a, b) for a in range(40) for b in range(a + 1, 40) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert all(got[i] == comp.get(i, i) for i in range(40))


def test_residual_links_what_stars_leave(spark):
    """a and c link only through b, and the group's smallest member to none."""
    w = [f"w{i}" for i in range(200)]
    a, b, c = w[:], w[:], w[:]
    b[20] = b[60] = "edit"
    c[20] = c[60] = c[100] = c[140] = "edit"
    rows = [(i, " ".join(t), "", "", 1) for i, t in enumerate([a, b, c])]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    h = near_dedup.WordHashes()
    ready = lambda x: near_dedup.Prepared(near_dedup.word_codes(" ".join(x), h))
    sim = lambda x, y: near_dedup.similarity(ready(x), ready(y))
    assert sim(a, b) >= 0.8 and sim(b, c) >= 0.8
    assert {r.component_id for r in got} == {0}


def test_alignment():
    lcs = near_dedup.banded_lcs
    for seed in range(40):
        rng = np.random.default_rng(seed)
        a, b = rng.integers(0, 6, 25).astype(np.uint64), rng.integers(0, 6, 30).astype(np.uint64)
        t = np.zeros((26, 31), int)
        for i in range(25):
            for j in range(30):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert lcs(a, b) == t[-1, -1]
    assert near_dedup.increasing(np.array([3, 1, 2, 9, 4, 5])).tolist() == [1, 2, 4, 5]


# ---- WARC --------------------------------------------------------------------------


def test_normalise_rewrites_each_record():
    records = [warc.record(i, "http://x/\r\n", b"p" * i * 1000, hashlib.sha256(b"p" * i * 1000).hexdigest(), i * 1000, None) for i in range(5)]
    for source in (gzip.compress(b"".join(records)), b"".join(gzip.compress(r) for r in records)):
        out, index = io.BytesIO(), io.BytesIO()
        assert warc.normalise(io.BytesIO(source), out, index) == 5
        lines = [json.loads(x) for x in index.getvalue().splitlines()]
        for r, line in zip(records, lines, strict=True):
            assert zlib.decompress(out.getvalue()[line["offset"] : line["offset"] + line["length"]], warc.GZIP) == r
    with pytest.raises(ValueError):
        warc.normalise(io.BytesIO(gzip.compress(records[1][:-300])), io.BytesIO(), io.BytesIO())


def test_inflation_is_bounded_and_whole():
    bomb = gzip.compress(b"x" * 30_000_000)
    sizes = [len(p) for p in warc.inflated(io.BytesIO(bomb), 1 << 16)]
    assert max(sizes) <= 1 << 16 and sum(sizes) == 30_000_000
    for cut in (1, 8, 100):
        with pytest.raises(ValueError):
            list(warc.inflated(io.BytesIO(bomb[:-cut])))
    assert b"".join(warc.inflated(io.BytesIO(gzip.compress(b"a") + gzip.compress(b"b")), 3)) == b"ab" and not list(warc.inflated(io.BytesIO(b"")))
    with pytest.raises(ValueError):
        list(warc.split_records(iter([b"no header " * 500_000])))


def test_warc_ids_are_integers_and_columns_may_clash(spark):
    with pytest.raises(TypeError):
        warc.round_trip(spark.createDataFrame([("a", "u", "h")], "page_id string, url string, html string"))
    d = spark.createDataFrame([(1, "u", "h" * 200, 5), (2, "u", "h" * 200, 6)], "page_id int, url string, html string, n int").selectExpr("*", "1 AS digest", "2 AS size", "3 AS first", "4 AS refers_to", "5 AS payload_bytes")
    assert {(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(d).collect()} == {(1, "response", None), (2, "revisit", 1)}


def test_warc_round_trip(spark):
    big, small = "é" * 80, "tiny"
    rows = [(5, "u", big), (3, None, big), (9, "u\nv", big), (1, "u", small), (2, "u", small), (4, "u", None), (6, "u", "x" * 300_000), (None, "u", "n" * 200)]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert len(got) == 8
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == hashlib.sha256(data).hexdigest()
    assert {i: (r.record_type, r.refers_to) for i, r in got.items() if i in (3, 5, 9, 1, 2)} == {3: ("response", None), 5: ("revisit", 3), 9: ("revisit", 3), 1: ("response", None), 2: ("response", None)}
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
