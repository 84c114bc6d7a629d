"""The registered queries of the operators, with production parameters over whole
tables. Each derives its digest columns from its operator's results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, langid, near_dedup, packing, pieces, pii, secrets, toxicity, vector_dedup, warc
from .common import crc_mod, table

#: Where the public tokenizer files are; None: the installed package's folder.
TOKENIZER_DIR: str | None = None


def tokenizer_path(name: str) -> str:
    if TOKENIZER_DIR is not None:
        return f"{TOKENIZER_DIR}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    return packing.pack(table(spark, sf_dir, "documents"), lambda: packing.byte_bpe_encoder(path))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_mod("doc_id", 5) != 0))
    found = langid.identify(docs, model)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def toxic_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the labelled rows that may be learned from; a
    document with labels that differ counts as toxic."""
    marks = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(crc_mod("doc_id", 3) != 1)
    return docs.select("doc_id", "text").join(marks, "doc_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxic_labels(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model)
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of the secret scan: the base kinds."""
    return secrets.find_secrets(table(spark, sf_dir, "documents")).drop("spans")


def base_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of the personal-data scan: the base kinds."""
    return pii.find_personal_data(table(spark, sf_dir, "documents")).drop("spans")


def _spans_sql(kinds: dict[str, tuple[str, str]]) -> str:
    """SQL for the counts and the digest of spans. ``kinds``: name -> (pattern, a
    condition on the match ``m``). Matches are marked in the text, which is then cut at
    the marks; a match begins where the pieces before it end."""
    marked = "\nUNION ALL ".join(
        f"SELECT r, '{k}' AS k, {o} AS o, string_split(regexp_replace(t, '({p})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts FROM d" for o, (k, (p, _)) in enumerate(kinds.items())
    )
    fits = " OR ".join(f"(k = '{k}' AND {c})" for k, (_, c) in kinds.items())
    counts = ", ".join(f"count(*) FILTER (WHERE k = '{k}') AS n_{k}" for k in kinds)
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), marked AS ({marked}),
pieces AS (SELECT r, k, o, unnest(parts) AS piece, generate_subscripts(parts, 1) AS i FROM marked WHERE len(parts) > 1),
placed AS (SELECT *, split_part(piece, chr(2), 1) AS m, sum(length(piece) - (i > 1)::INT) OVER (PARTITION BY r, k ORDER BY i) - length(piece) + (i > 1)::INT AS a FROM pieces),
spans AS (SELECT r, k, o, CAST(a AS BIGINT) AS a, CAST(a + length(m) AS BIGINT) AS b FROM placed WHERE i > 1 AND ({fits}))
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(k || ':' || a || ':' || b, ',' ORDER BY a, o), '')) AS base_sha256 FROM d LEFT JOIN spans ON spans.r = d.r GROUP BY d.r, d.doc_id"""


_ANY_CASE = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_KEYS = "|".join(map(_ANY_CASE, ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN = f"(?:{_KEYS})[\"'']?\\x20*[:=]\\x20*[\"'']?[A-Za-z0-9+/_.=-]+"
_VALUE = f"(?:{_KEYS})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = (
    f"list_sum(list_transform(range(length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr({_DIGITS}, length({_DIGITS}) - i, 1) AS INT) "
    f"ELSE 2 * CAST(substr({_DIGITS}, length({_DIGITS}) - i, 1) AS INT) - 9 * (CAST(substr({_DIGITS}, length({_DIGITS}) - i, 1) AS INT) > 4)::INT END)) % 10 = 0"
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_packing, op3_language_id, op4_nearest_neighbours, op5_warc, op6_personal_data,
        op7_sentencepiece, op8_vector_near_dedup, op9_near_dedup, op10_toxicity, base_secrets, base_personal_data,
    )
}

ORACLES: dict[str, str] = {
    "base_secrets": _spans_sql({
        "assign": (_ASSIGN, f"length(regexp_extract(m, '{_VALUE}', 1)) >= 6"), "access": ("AKIA[A-Z0-9]+", "length(m) >= 20"), "hex": ("[0-9a-f]+", "length(m) >= 24"),
    }),
    "base_personal_data": _spans_sql({
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(?:\.[0-9]+){3}", "list_max(list_transform(string_split(m, '.'), lambda x: CAST(x AS HUGEINT))) <= 255"),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
    }),
    "op5_warc": """WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100""",
    "op8_vector_near_dedup": """WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END), 'sum') = 0 AND list_inner_product(embedding, embedding) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
w AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT w.x, l.y FROM w JOIN l ON l.x = w.y),
c AS (SELECT x, min(y) AS component_id FROM w GROUP BY x), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT c.x AS vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.x = c.component_id AS kept FROM c LEFT JOIN n ON n.x = c.x""",
}
