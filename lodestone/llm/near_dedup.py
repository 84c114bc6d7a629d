"""Near-duplicate documents by Order MinHash.

A document is its lower-cased words split at white space; its k-mers are runs of
five words (all words, if fewer), each labelled with its occurrence number. A
sketch entry takes the ``chosen`` k-mers with the smallest hashes under one hash
function and keeps their order in the text, so it agrees only where the content
and its order do. Entries are banded; documents that share a band are candidates.

A pair is linked if its similarity is 0.8 or more: both texts are aligned inside a
band, and the similarity is the number of five-word runs that the alignment matches
over the number in either text. It is at most the Jaccard similarity of the k-mers,
which is checked first, and equals it where no passage has moved. Texts that repeat
themselves are compared twice, with all k-mers and with the first occurrence of
each, and the larger similarity counts; they are sketched both ways too.

Copies and hubs: documents with equal word sequences form one class, represented
by its smallest id, and only representatives are compared. In a band's group each
representative is first compared with the group's smallest one (a star, not all
pairs). After that only pairs whose components still differ are compared, where the
group lies, in blocks of bounded rows and bytes; a pair is compared in the first
band that it shares, and not at all once other links of the block connect it. A
block returns the edges of a forest, so a large group of near copies costs rows in
proportion to its size and no link between different texts is lost.

Results for odd input: a null text and a text without words link with nothing;
rows that repeat an id share its result; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, stored
from .components import components

KMER, LEAST = 5, 0.8
BANDS, ROWS, CHOSEN = 20, 2, 2
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """word -> 64-bit hash, remembering up to ``most`` words."""

    def __init__(self, most: int = 120_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def word_codes(text: str | None, hashes: WordHashes) -> np.ndarray:
    words = text.lower().split() if text else []
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def kmers(codes: np.ndarray, k: int = KMER) -> np.ndarray:
    """A hash for each run of ``k`` words; one of all words if there are fewer."""
    if not len(codes):
        return codes
    k = min(k, len(codes))
    n = len(codes) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = mixed(h * np.uint64(31) + codes[i : i + n])
    return h


def labelled(h: np.ndarray) -> np.ndarray:
    """The hashes with each one's occurrence number mixed in."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.r_[True, s[1:] != s[:-1]]
    if first.all():
        return h
    at = np.arange(len(h))
    number = at - np.maximum.accumulate(np.where(first, at, 0))
    out = np.empty_like(h)
    out[order] = np.where(number > 0, mixed(s + number.astype(np.uint64) * _M2), s)
    return out


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def order_minhash(h: np.ndarray, n: int, chosen: int = CHOSEN, block: int = 8) -> np.ndarray:
    """``n`` sketch entries of labelled k-mer hashes ``h`` (at least one)."""
    factors, offsets = _functions(n)
    out = np.zeros(n, np.uint64)
    take = min(chosen, len(h))
    for lo in range(0, n, block):
        v = h[None, :] * factors[lo : lo + block, None] + offsets[lo : lo + block, None]
        v ^= v >> np.uint64(29)
        if take < len(h):
            places = np.argpartition(v, take - 1, axis=1)[:, :take]
        else:
            places = np.tile(np.arange(len(h)), (len(v), 1))
        places.sort(axis=1)  # the order in the text
        e = np.zeros(len(v), np.uint64)
        for j in range(take):
            e = mixed(e * np.uint64(31) + h[places[:, j]])
        out[lo : lo + block] = e
    return out


def bands_of(entries: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = entries.reshape(bands, -1)
    e = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(parts.shape[1]):
        e = mixed(e * np.uint64(31) + parts[:, j])
    return e.view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, size, key, bands, entries) of every document with a word. th: a hash of
    the text, size: its bytes, key: a 128-bit hash of the word sequence; bands and
    entries (16 bits of each) come twice, with all k-mers and with the first of each."""
    t = F.col(text_col)
    rows = docs.where(F.col(id_col).isNotNull() & t.isNotNull()).select(F.col(id_col).alias("id"), t.alias("t"), F.xxhash64(t).alias("th"), F.octet_length(t).cast("long").alias("size"))
    id_type = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            at, keys, bands, entries = [], [], [], []
            for i, t in enumerate(batch.column(1)):
                codes = word_codes(t.as_py(), hashes)
                if len(codes):
                    h = kmers(codes)
                    e = order_minhash(labelled(h), BANDS * ROWS)
                    once = first_of_each(h)
                    f = e if len(once) == len(h) else order_minhash(once, BANDS * ROWS)
                    at.append(i)
                    keys.append(xxhash.xxh3_128_digest(codes.tobytes()))
                    bands.append(np.concatenate([bands_of(e), bands_of(f)]))
                    entries.append((np.concatenate([e, f]) & np.uint64(0xFFFF)).astype("<u2").tobytes())
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(take) for i in (0, 2, 3)), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(entries, pa.binary())],
                names=["id", "th", "size", "key", "bands", "entries"],
            )

    return rows.mapInArrow(frugal(run), f"id {id_type}, th long, size long, key binary, bands array<long>, entries binary")


def one_text_per_id(sketch: DataFrame) -> DataFrame:
    """The sketches of the text that stands for each id."""
    repeated = stored(sketch.groupBy("id").agg(F.min("th").alias("own"), F.max("th").alias("last")).where("own <> last").select("id", "own"), "repeated")
    if repeated.isEmpty():
        return sketch
    return sketch.join(repeated, "id", "left").where("own is null or own = th").drop("own")


#: A pair at similarity 0.8 is expected to share 0.64 of its sketch entries; with
#: fewer than this share (over four deviations less) it is not aligned.
ENTRIES_SHARED = 0.3


def first_of_each(h: np.ndarray) -> np.ndarray:
    """The first occurrence of each value, in order."""
    at = np.unique(h, return_index=True)[1]
    at.sort()
    return h[at]


class Prepared:
    """What comparing a text takes, worked out once."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.all = kmers(codes)
        self.labelled = labelled(self.all)
        self.once = first_of_each(self.all) if len(codes) >= KMER else self.all


def similarity(a: Prepared, b: Prepared, least: float = LEAST) -> float:
    """Aligned k-mer similarity of two texts, the larger of all k-mers and first
    occurrences; 0 where it is certain to be under ``least``."""
    if not len(a.codes) or not len(b.codes):
        return 0.0
    if len(a.codes) < KMER or len(b.codes) < KMER:
        return float(np.array_equal(a.codes, b.codes))
    best = _aligned_share(a.all, b.all, a.labelled, b.labelled, least)
    if best < least and (len(a.once) < len(a.all) or len(b.once) < len(b.all)):
        best = max(best, _aligned_share(a.once, b.once, a.once, b.once, least))
    return best


def _aligned_share(ka: np.ndarray, kb: np.ndarray, la: np.ndarray, lb: np.ndarray, least: float) -> float:
    if min(len(ka), len(kb)) < least * max(len(ka), len(kb)):
        return 0.0
    both = len(np.intersect1d(la, lb, assume_unique=True))
    if both < least * (len(la) + len(lb) - both) - 1e-9:
        return 0.0
    matched = aligned_kmers(ka, kb)
    return matched / (len(ka) + len(kb) - matched)


def aligned_kmers(ka: np.ndarray, kb: np.ndarray) -> int:
    """k-mers matched by an alignment of two k-mer sequences inside a band.

    K-mers that occur once in each text anchor the alignment; the longest chain of
    anchors in both orders is kept, and between neighbouring anchors the gaps are
    aligned by dynamic programming over k-mers inside a band as wide as the larger
    gap's share of edits allows."""
    ua, ia, na = np.unique(ka, return_index=True, return_counts=True)
    ub, ib, nb = np.unique(kb, return_index=True, return_counts=True)
    _, pa_, pb_ = np.intersect1d(ua[na == 1], ub[nb == 1], assume_unique=True, return_indices=True)
    x, y = ia[na == 1][pa_], ib[nb == 1][pb_]
    order = np.argsort(x)
    chain = increasing(y[order])
    x, y = x[order][chain], y[order][chain]
    total = len(x)
    # Gaps between anchors: only those with k-mers left on both sides need a look.
    fx, fy = np.r_[-1, x, len(ka)], np.r_[-1, y, len(kb)]
    for i in np.flatnonzero((np.diff(fx) > 1) & (np.diff(fy) > 1)):
        total += banded_lcs(ka[fx[i] + 1 : fx[i + 1]], kb[fy[i] + 1 : fy[i + 1]])
    return total


def increasing(y: np.ndarray) -> np.ndarray:
    """Indices of a longest increasing subsequence of distinct values."""
    if len(y) < 2 or (np.diff(y) > 0).all():
        return np.arange(len(y))
    from bisect import bisect_left

    tails: list[int] = []
    ends: list[int] = []
    back = np.full(len(y), -1)
    for i, v in enumerate(y.tolist()):
        at = bisect_left(tails, v)
        if at == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[at], ends[at] = v, i
        back[i] = ends[at - 1] if at else -1
    out, at = [], ends[-1]
    while at >= 0:
        out.append(at)
        at = back[at]
    return np.array(out[::-1])


def banded_lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Longest common subsequence inside a band around the diagonal. The band is
    a fifth of the longer side and at least 32 wide, past the length difference:
    pairs at the least similarity stay inside it."""
    if len(a) > len(b):
        a, b = b, a
    # What both begin or end with is matched, as in some longest subsequence.
    ends = 0
    for _ in range(2):
        apart = np.flatnonzero(a != b[: len(a)])
        same = int(apart[0]) if len(apart) else len(a)
        a, b, ends = a[same:][::-1], b[same:][::-1], ends + same
    m, n = len(a), len(b)
    if not m or not len(np.intersect1d(a, b)):
        return ends
    half = max(32, n // 5) + (n - m)
    row = np.zeros(n + 1, np.int32)
    for i in range(m):
        lo, hi = max(0, i - half), min(n, i + half + 1)
        # new[j+1] = max(old[j+1], new[j], old[j] + 1 where equal): the middle term
        # is a running maximum.
        take = np.maximum(row[lo + 1 : hi + 1], (row[lo:hi] + 1) * (b[lo:hi] == a[i]))
        row[lo + 1 : hi + 1] = np.maximum.accumulate(np.maximum(take, row[lo] if lo else 0))
        if hi < n:
            row[hi + 1 :] = np.maximum(row[hi + 1 :], row[hi])
    return ends + int(row.max())


def _agree(entries: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Row-wise: sketches agree in one of their two halves."""
    same = (entries == other).reshape(len(entries), 2, -1).mean(axis=2)
    return same.max(axis=1) >= ENTRIES_SHARED


def _unpacked(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), -1)


#: A fixed number of hash buckets: the broadcast that thins the texts out before
#: they are shuffled has at most so many rows.
BUCKETS = 1 << 18


def texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t) of the documents in ``ids`` (id, th). While the wanted ids leave most
    hash buckets empty, only texts in a bucket of a wanted id are shuffled."""
    ids = stored(ids.select("id", "th").distinct(), "wanted")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null")
    if ids.count() < BUCKETS:
        bucket = F.pmod(F.xxhash64("id"), F.lit(BUCKETS))
        some = ids.select(bucket.alias("_b")).distinct()
        texts = texts.withColumn("_b", bucket).join(F.broadcast(some), "_b", "left_semi").drop("_b")
    near = texts.withColumn("th", F.xxhash64("t")).join(ids, ["id", "th"], "left_semi")
    return near.groupBy("id").agg(F.min("t").alias("t"))


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of ``reps`` (id, th) whose texts are similar."""
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    ends = reps.select("id", "th").join(ends, "id")
    texts = stored(texts_of(docs, ends, id_col, text_col), "texts")
    id_type = pairs.schema["a"].dataType.simpleString()
    both = (
        pairs.join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
        .join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a")
        .select("a", "b", "ta", "tb")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(100_000)
        last: tuple[str | None, Prepared | None] = (None, None)
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2), batch.column(3), strict=True):
                left = ta.as_py()
                if left != last[0]:  # pairs of one hub follow each other
                    last = (left, Prepared(word_codes(left, hashes)))
                keep.append(similarity(last[1], Prepared(word_codes(tb.as_py(), hashes))) >= LEAST)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(frugal(run), f"a {id_type}, b {id_type}")


def _labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): each node's component under ``edges``, itself without any."""
    found = components(edges).withColumnRenamed("node", "id")
    return nodes.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("label"))


def _blocks(members: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    """The members (band, id, size, ...) dealt to pairs of blocks of their band's group:
    band, p, q and x, the member's own block."""
    per = members.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    k = F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("s") / block_bytes), F.lit(1)).cast("int")
    dealt = members.join(per.select("band", k.alias("k")), "band").withColumn("x", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least(o, F.col("x")).alias("p"), F.greatest(o, F.col("x")).alias("q")))
    return dealt.withColumn("o", F.explode(others)).select("band", "o.p", "o.q", "x", "id", "th", "label", "entries", "bands")


class _Group:
    """The members of one pair of blocks, and which of them to compare."""

    def __init__(self, table: pa.Table):
        self.band, self.p, self.q = (table[c][0].as_py() for c in ("band", "p", "q"))
        labels = table["label"].to_pylist()
        number = {v: i for i, v in enumerate(dict.fromkeys(labels))}
        self.label = np.array([number[v] for v in labels])
        self.entries, x = _unpacked(table["entries"]), table["x"].to_numpy()
        self.keys = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(labels), 2, -1)
        self.left, self.right = np.flatnonzero(x == self.p), np.flatnonzero(x == self.q)

    def partners(self, i: int) -> np.ndarray:
        """Members of other components in the right block whose sketch agrees with
        ``i``'s and whose first band shared with it is this one."""
        js = self.right[self.right > i] if self.p == self.q else self.right
        js = js[self.label[js] != self.label[i]]
        if len(js):
            js = js[_agree(self.entries[js], self.entries[i][None, :])]
        if len(js):
            same = self.keys[js] == self.keys[i]
            first = np.where(same, self.keys[i], np.iinfo(np.int64).max).reshape(len(js), -1).min(axis=1)
            js = js[first == self.band]
        return js


def _residual(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, block_rows: int = 1_000, block_bytes: int = 8 << 20) -> DataFrame:
    """Links between members of a band group whose components differ: (a, b), a
    forest for each pair of blocks. ``members``: band, id, th, size, label, entries,
    bands. Groups over a block's bounds are dealt to pairs of blocks, by sketch; texts
    go only to those that have a partner there."""
    id_type = members.schema["id"].dataType.simpleString()
    placed = _blocks(members, block_rows, block_bytes)

    def needed(table: pa.Table) -> pa.Table:
        group, take = _Group(table), set()
        for i in group.left:
            if len(js := group.partners(i)):
                take.add(int(i))
                take.update(js.tolist())
        return table.take(pa.array(sorted(take), pa.int64()))

    active = stored(placed.groupBy("band", "p", "q").applyInArrow(needed, placed.schema), "open")
    texts = texts_of(docs, active, id_col, text_col)

    def run(table: pa.Table) -> pa.Table:
        group, ids = _Group(table), table["id"].to_pylist()
        label, texts, hashes, ready = group.label, table["t"], WordHashes(), {}

        def prepared(i: int) -> Prepared:
            if i not in ready:
                ready[i] = Prepared(word_codes(texts[i].as_py(), hashes))
            return ready[i]

        out_a, out_b = [], []
        for i in group.left:
            for j in group.partners(i):
                if label[i] != label[j] and similarity(prepared(i), prepared(j)) >= LEAST:
                    out_a.append(min(ids[i], ids[j]))
                    out_b.append(max(ids[i], ids[j]))
                    label[label == label[j]] = label[i]
        kind = table.schema.field("id").type
        return pa.table({"a": pa.array(out_a, kind), "b": pa.array(out_b, kind)})

    return active.join(texts, "id").groupBy("band", "p", "q").applyInArrow(run, f"a {id_type}, b {id_type}")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component): the smallest id of each document's near-duplicate class,
    for ids that share theirs with another; other ids are not listed."""
    sketch = one_text_per_id(stored(sketches(docs, id_col, text_col), "sketches"))
    least = sketch.groupBy("key").agg(F.min("id").alias("rep"))
    member_of = sketch.select("key", "id").distinct().join(least, "key").select("id", "rep")
    reps = stored(
        sketch.groupBy("key").agg(F.min(F.struct("id", "th", "size", "bands", "entries")).alias("s")).select("s.*"), "reps"
    )
    spread = reps.select("id", F.explode(F.array_distinct("bands")).alias("band"))
    # Star: each member with its group's smallest id; hot groups aggregate map-side.
    groups = spread.groupBy("band").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = stored(spread.join(groups, "band").select("band", "id", "a"), "bands")
    star = shared.where("id <> a").select("a", F.col("id").alias("b")).distinct()
    tested = stored(_sketch_agrees(star, reps), "pairs")
    linked = stored(verified(tested, reps, docs, id_col, text_col), "linked")
    # Residual: what the stars left in different components.
    labels = stored(_labels(reps.select("id"), linked), "labels")
    members = shared.select("band", "id").join(labels, "id")
    open_groups = members.groupBy("band").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("band")
    members = stored(members.join(open_groups, "band"), "open").join(reps, "id")
    more = stored(_residual(members, docs, id_col, text_col), "linked")
    edges = linked.unionByName(more).unionByName(
        member_of.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    )
    found = components(edges)
    return found.select(F.col("node").alias("id"), "component")


def _sketch_agrees(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs whose sketches agree in ``ENTRIES_SHARED`` of the entries or more."""
    id_type = pairs.schema["a"].dataType.simpleString()
    e = reps.select("id", "entries")
    both = pairs.join(e.select(F.col("id").alias("a"), F.col("entries").alias("ea")), "a").join(
        e.select(F.col("id").alias("b"), F.col("entries").alias("eb")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = _agree(_unpacked(batch.column("ea")), _unpacked(batch.column("eb")))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ea", "eb").mapInArrow(frugal(run), f"a {id_type}, b {id_type}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, component_id (its class), kept (it is the one
    that stands for its class)."""
    found = classes(docs, id_col, text_col).withColumnRenamed("id", id_col)
    rows = docs.select(id_col).join(found, id_col, "left")
    component: Column = F.coalesce("component", id_col)
    return rows.select(id_col, component.alias("component_id"), F.coalesce(component == F.col(id_col), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that stand for their class, one for each."""
    gone, own, again = (f"_{name}_{uuid.uuid4().hex}" for name in ("gone", "own", "again"))
    found = classes(docs, id_col, text_col).where("id <> component").select(F.col("id").alias(gone))
    kept = docs.join(found, F.col(f"`{id_col}`") == F.col(gone), "left_anti")
    # Ids that repeat among those kept: of each one row stays, with the text that stands for it.
    th = F.xxhash64(F.col(text_col))
    per = kept.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(own)).agg(F.count("*").alias("n"), F.min(F.when(F.col(text_col).isNotNull(), th)).alias(again))
    per = stored(per.where("n > 1").drop("n"), "repeated")
    if per.isEmpty():
        return kept
    on = F.col(f"`{id_col}`") == F.col(own)
    some = kept.join(per, on).where(F.col(again).isNull() | (F.col(text_col).isNotNull() & (th == F.col(again)))).drop(own, again).dropDuplicates([id_col])
    return kept.join(per, on, "left_anti").unionByName(some)
