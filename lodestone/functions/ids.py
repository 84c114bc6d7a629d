"""Stable identities: ``prefix:`` and 20 hex digits of the SHA-256 of the parts,
each part followed by a NUL. As columns, as SQL functions and in Python."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

NUL = "\0"
DIGITS = 20


def _column(part: Column | str) -> Column:
    return part if isinstance(part, Column) else F.lit(part)


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """Strings are literals, columns are columns."""
    text = F.concat(*[x for p in parts for x in (_column(p).cast("string"), F.lit(NUL))])
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(text, 256), 1, DIGITS))


def py_stable_id(prefix: str, *parts: object) -> str:
    text = "".join(f"{p}{NUL}" for p in parts)
    return f"{prefix}:{hashlib.sha256(text.encode()).hexdigest()[:DIGITS]}"


def node_id(kind: Column | str, qualified_name: Column | str, *more: Column | str) -> Column:
    return stable_id("n", kind, qualified_name, *more)


def external_id(kind: Column | str, name: Column | str) -> Column:
    k = _column(kind)
    return node_id(F.when(k == "", "external").otherwise(k), F.concat(F.lit("external:"), _column(name)))


def fact_id(owner, source, kind, target, line, ordinal) -> Column:
    return stable_id("f", owner, source, kind, target, line, ordinal)


def edge_id(fact: Column | str, to: Column | str) -> Column:
    return stable_id("e", fact, to)


def derived_edge_id(fact: Column | str, to: Column | str, kind: str) -> Column:
    """Edges of kind ``tests`` share fact and target with their evidence, so the
    kind is part of their identity."""
    return stable_id("e", fact, to, kind) if kind == "tests" else edge_id(fact, to)


def register_sql(spark: SparkSession) -> None:
    """``stable_id2(prefix, a, b)`` and ``edge_id(fact, to)`` for SQL users."""
    body = "concat(p, ':', substr(sha2(concat(a, char(0), b, char(0)), 256), 1, 20))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION stable_id2(p STRING, a STRING, b STRING) RETURNS STRING RETURN {body}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION edge_id(a STRING, b STRING) RETURNS STRING RETURN concat('e:', substr(sha2(concat(a, char(0), b, char(0)), 256), 1, 20))")


# ---- compact form -------------------------------------------------------------


def to_blob(identity: Column) -> Column:
    """A printable identity as prefix byte and ten digest bytes; sorts alike
    within a prefix."""
    return F.concat(F.encode(F.substring(identity, 1, 1), "UTF-8"), F.unhex(F.substring(identity, 3, DIGITS)))


def from_blob(blob: Column) -> Column:
    return F.concat(F.decode(F.substring(blob, 1, 1), "UTF-8"), F.lit(":"), F.lower(F.hex(F.substring(blob, 2, 10))))


def packed(identity: Column) -> Column:
    """An identity in half its length, other text behind a byte 1: what is dealt is
    shorter, and equal only where the texts are."""
    return F.when(identity.rlike(r"^[a-z]:[0-9a-f]{20}$"), to_blob(identity)).otherwise(F.concat(F.lit(bytearray(1)), F.encode(identity, "UTF-8")))


def unpacked(blob: Column) -> Column:
    return F.when(F.substring(blob, 1, 1) == F.lit(bytearray(1)), F.decode(F.substring(blob, 2, 2**31 - 1), "UTF-8")).otherwise(from_blob(blob))
