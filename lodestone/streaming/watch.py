"""Continuous maintenance: a stream of changed files refreshes the stored index, one
snapshot a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import changes, evidence_digest, really_changed, refresh, upsert
from ..plans.scratch import stored
from ..sources.extract import extract
from ..sources.store import Store
from ..vocab import FILES

CHANGES = "repository string, path string, content string, hash string, sequence long"


def apply_changes(store: Store, batch: DataFrame) -> str | None:
    """Apply (repository, path, content, hash, sequence) rows, the last of a path
    winning and a null content removing it; the new version, or None if nothing
    changed. Applying a batch again changes nothing. A changed file whose evidence is the
    same as before only updates the ledger."""
    last = upsert(batch, ["repository", "path"], "sequence").drop("sequence")
    old = store.read()
    kept = old["files"].join(last.select("repository", "path"), ["repository", "path"], "left_anti")
    alive = last.where("content is not null")
    now = kept.select("repository", "path", "hash").unionByName(alive.select("repository", "path", "hash"))
    touched = changes(old["files"], now).where("change <> 'same'")
    if touched.isEmpty():
        return None
    touched = stored(touched, "touched")
    moved = touched.select("repository", "path")
    nodes, facts, _ = extract(alive.join(moved, ["repository", "path"], "left_semi"))
    digests = stored(evidence_digest(nodes, facts), "digests")
    known = old["files"].select("repository", F.col("path").alias("owner_file"), F.nullif("evidence_digest", F.lit("")).alias("digest"))
    owners = really_changed(touched.where("change = 'changed'"), known, digests).unionByName(touched.where("change <> 'changed'").select("repository", "path"))
    owners = stored(owners, "owners")
    n, f, e, x = old["nodes"].where("not external"), old["facts"], old["edges"], old["nodes"].where("external")
    if not owners.isEmpty():
        own = owners.withColumnRenamed("path", "owner_file")
        nodes, facts = (t.join(own, ["repository", "owner_file"], "left_semi").select(*t.columns) for t in (nodes, facts))
        n, f, e, x = refresh(n, f, e, x, owners, nodes, facts)
    rows = alive.join(moved, ["repository", "path"], "left_semi").join(digests.withColumnRenamed("owner_file", "path"), ["repository", "path"], "left").select(
        "repository", "path", "hash", F.lit("").alias("language"), F.octet_length("content").cast("long").alias("size"), F.lit(0).cast("long").alias("modified_ns"), F.coalesce("digest", F.lit("")).alias("evidence_digest")
    )
    files = old["files"].join(moved, ["repository", "path"], "left_anti").select(*FILES.fieldNames()).unionByName(rows)
    return store.write(n.unionByName(x), f, e, files)


def watch(spark: SparkSession, changes_dir: str, store: Store, checkpoint: str) -> StreamingQuery:
    """Follow a folder of JSON change records; start with ``processAllAvailable`` or
    leave running."""
    stream = spark.readStream.schema(CHANGES).json(changes_dir)
    return stream.writeStream.foreachBatch(lambda df, _: apply_changes(store, df)).option("checkpointLocation", checkpoint).start()
