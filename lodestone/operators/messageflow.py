"""Message flow: how each canonical message is bound, encoded, sent, received,
decoded and handled, for all messages at once.

Evidence is a long table (message, role, ...); a role's counts, not its lists, are
what classification needs, so every gap is a condition over one aggregated row a
message or member. Uncertain or truncated evidence makes a status ``unknown`` and
never a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import stored
from .catalog import relation_sites
from .match import canonical_messages
from .reports import one_per_id
from .resolve import prop

GENERATORS = ("protoc-gen-go", "protoc-gen-gdscript")
ROLES_IN = {"generated_from": "binding", "encodes": "encoder", "decodes": "decoder", "carries": "carrier"}


def evidence(edges: DataFrame, nodes: DataFrame, messages: DataFrame, limit: int = 1000) -> DataFrame:
    """``messages``: (id) -> message, member ('' for the message's own evidence),
    role, edge_id, node_id, qualified_name, repository, unresolved, truncated.

    Roles: binding, encoder, decoder, send, receive (transport operations that carry
    the message), member, producer, consumer (writes and reads of a member), handler
    (callers of decoders and consumers), dynamic (transport operations of a codec
    whose payload is not proven)."""
    into = stored(relation_sites(edges, nodes, messages, ROLES_IN, "in", limit), "flow")
    props = one_per_id(nodes).select(F.col("id").alias("node_id"), "properties")
    cols = ["message", "member", "role", "edge_id", "node_id", "qualified_name", "repository", "unresolved", "truncated"]
    base = into.withColumnsRenamed({"subject": "message", "relation": "role", "external": "unresolved"}).withColumn("member", F.lit(""))
    carriers = base.where("role = 'carrier'").join(props, "node_id", "left")
    carriers = carriers.withColumn("role", F.when(prop(F.col("properties"), "direction") == "receive", "receive").otherwise("send"))
    fields = relation_sites(edges, nodes, messages, {"has_field": "member"}, "out", limit)
    fields = stored(fields.withColumnsRenamed({"subject": "message", "relation": "role", "external": "unresolved"}).withColumn("member", F.col("node_id")), "fields")
    of = fields.select("message", F.col("node_id").alias("subject")).distinct()
    uses = relation_sites(edges, nodes, of.select(F.col("subject").alias("id")), {"writes": "producer", "reads": "consumer"}, "in", limit).join(of, "subject")
    uses = stored(uses.withColumnsRenamed({"subject": "member", "relation": "role", "external": "unresolved"}).select(*cols), "uses")
    plain = base.where("role <> 'carrier'").select(*cols)
    codecs = plain.where("role in ('encoder', 'decoder')").select("message", F.col("node_id").alias("subject"), "role").distinct()
    sends = relation_sites(edges, nodes, codecs.select(F.col("subject").alias("id")), {"sends": "encoder", "receives": "decoder"}, "out", limit)
    proven = props.where(prop(F.col("properties"), "payload_status") == "proven").select("node_id")
    dynamic = sends.join(codecs, (sends["subject"] == codecs["subject"]) & (sends["relation"] == codecs["role"])).drop(codecs["subject"]).drop("role")
    dynamic = dynamic.join(proven, "node_id", "left_anti").join(carriers.select("message", "node_id"), ["message", "node_id"], "left_anti")
    dynamic = dynamic.withColumnsRenamed({"relation": "role", "external": "unresolved"}).withColumns({"role": F.lit("dynamic"), "member": F.lit("")}).select(*cols)
    listeners = plain.where("role = 'decoder'").select("message", "node_id").unionByName(uses.where("role = 'consumer'").select("message", "node_id")).distinct()
    called = relation_sites(edges, nodes, listeners.select(F.col("node_id").alias("id")), {"calls": "handler"}, "in", limit)
    called = called.join(listeners.withColumnRenamed("node_id", "subject"), "subject").withColumnsRenamed({"relation": "role", "external": "unresolved"}).withColumn("member", F.lit("")).select(*cols)
    out = plain.unionByName(carriers.select(*cols)).unionByName(fields.select(*cols)).unionByName(uses).unionByName(dynamic).unionByName(called)
    return out.dropDuplicates(["message", "member", "role", "edge_id"])


def channel_conflicts(sends_receives: DataFrame, nodes: DataFrame) -> DataFrame:
    """(message, n): pairs of a proven send and a proven receive on unlike channels.
    Counted per channel, so no pairs are made: all pairs less those that agree."""
    flat = one_per_id(nodes).select(F.col("id").alias("node_id"), prop(F.col("properties"), "channel").alias("channel"), _proven().alias("proven"))
    per = sends_receives.join(flat, "node_id").where("proven and channel <> ''").groupBy("message", "channel").agg(F.count_if(F.col("role") == "send").alias("s"), F.count_if(F.col("role") == "receive").alias("r"))
    return per.groupBy("message").agg((F.sum("s") * F.sum("r") - F.sum(F.col("s") * F.col("r"))).alias("n")).where("n > 0")


def _proven():
    p = F.col("properties")
    return ~F.col("external") & (prop(p, "payload_status") == "proven") & (prop(p, "channel_status") == "proven")


def coverage(edges: DataFrame, nodes: DataFrame, messages: DataFrame, limit: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(flows, members). flows: message, counts of each role, truncated, uncertain,
    gaps, status; members: message, member, n_producers, n_consumers, gap, status."""
    found = stored(evidence(edges, nodes, messages, limit), "evidence")
    props = one_per_id(nodes).select(F.col("id").alias("node_id"), "properties", "external")
    count = lambda role: F.count_if(F.col("role") == role).alias(f"n_{role}")
    counts = found.groupBy("message").agg(*[count(r) for r in ("binding", "encoder", "decoder", "send", "receive", "member", "handler", "dynamic")], F.bool_or("truncated").alias("truncated"))
    # A binding's generator may stand on its node or on its edge.
    made = edges.select(F.col("id").alias("edge_id"), prop(F.col("properties"), "generator").alias("g"))
    binds = found.where("role = 'binding'").join(props, "node_id", "left").join(made, "edge_id", "left")
    generator = F.coalesce(F.nullif(prop(F.col("properties"), "generator"), F.lit("")), "g")
    binds = binds.groupBy("message").agg(F.bool_or("unresolved").alias("x"), F.bool_or(~F.coalesce(generator.isin(*GENERATORS), F.lit(False))).alias("y"))
    moved = found.where("role in ('send', 'receive')")
    dark = moved.join(props, "node_id", "left").groupBy("message").agg(F.bool_or(~_proven()).alias("dark"))
    conflicts = channel_conflicts(moved, nodes).withColumnRenamed("n", "n_conflicts")
    rows = messages.select(F.col("id").alias("message")).distinct().join(counts, "message", "left").join(binds, "message", "left").join(dark, "message", "left").join(conflicts, "message", "left")
    rows = rows.na.fill(0).na.fill(False)
    weak = (F.col("n_binding") == 0) | F.col("x") | F.col("y")
    uncertain = weak | F.col("dark") | (F.col("n_dynamic") > 0) | F.col("truncated")
    rows = rows.withColumns({"weak": weak, "uncertain": uncertain})
    uses = found.where("role in ('producer', 'consumer')").groupBy("message", "member").agg(F.count_if(F.col("role") == "producer").alias("n_producers"), F.count_if(F.col("role") == "consumer").alias("n_consumers"))
    parts = found.where("role = 'member'").select("message", "member").distinct().join(uses, ["message", "member"], "left").na.fill(0)
    parts = parts.join(rows.select("message", (F.col("weak") | F.col("truncated")).alias("unknown")), "message")
    p, c = F.col("n_producers") > 0, F.col("n_consumers") > 0
    gap = F.when(F.col("unknown"), "").when(~p & ~c, "unused").when(p & ~c, "produced_without_consumer").when(~p & c, "consumed_without_producer").otherwise("")
    status = F.when(F.col("unknown"), "unknown").when(F.col("gap") != "", "missing_evidence").otherwise("resolved")
    parts = parts.withColumn("gap", gap).withColumn("status", status).drop("unknown")
    missing = parts.groupBy("message").agg(F.bool_or(F.col("status") == "missing_evidence").alias("part_missing"))
    rows = rows.join(missing, "message", "left").na.fill(False)
    gaps = F.filter(
        F.array(
            F.when(~F.col("uncertain") & (F.col("n_encoder") > 0) & (F.col("n_send") == 0), "encoded_without_send"),
            F.when(~F.col("uncertain") & (F.col("n_receive") > 0) & (F.col("n_decoder") == 0), "received_without_decode"),
            F.when(F.col("n_conflicts") > 0, "channel_mismatch"),
        ),
        lambda x: x.isNotNull(),
    )
    state = F.when(F.col("uncertain"), "unknown").when((F.size("gaps") > 0) | F.col("part_missing"), "missing_evidence").otherwise("resolved")
    rows = rows.withColumn("gaps", gaps).withColumn("status", state)
    return rows.select("message", *[f"n_{r}" for r in ("binding", "encoder", "decoder", "send", "receive", "member", "handler", "dynamic", "conflicts")], "truncated", "uncertain", "gaps", "status"), parts


def owners_by_alias(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): a component itself, else the component of the file that a local
    node's id, owner, path, qualified name or name, in this order, stands for.

    A file answers to its id, qualified name, path and owner, and weakly to its name. A
    key of several files is dropped if one of them has it weakly; two components that
    claim one key otherwise raise."""
    local = nodes.where("not external")
    files = local.where("kind = 'file'").select("repository", F.col("id").alias("file"), "qualified_name", "path", "owner_file", "name")
    parts = local.where("kind = 'component'").select("repository", F.col("id").alias("component"))
    held = edges.where("kind = 'contains'").select(F.col("from_id").alias("component"), F.col("to_id").alias("file")).distinct()
    held = held.join(parts, "component").join(files, ["repository", "file"])
    alias = lambda c, weak: F.struct(F.col(c).alias("key"), F.lit(weak).alias("weak"))
    keys = F.array(*[alias(c, False) for c in ("file", "qualified_name", "path", "owner_file")], alias("name", True))
    claims = held.select("repository", "component", "file", F.explode(keys).alias("k")).where("k.key <> ''").groupBy("repository", "k.key").agg(
        F.count_distinct("file").alias("n"), F.bool_or("k.weak").alias("weak"), F.min("component").alias("c"), F.max("component").alias("d")
    )
    claims = claims.where("n = 1 or not weak")
    conflict = F.raise_error(F.concat(F.lit("two components own "), F.col("key"))).cast("string")
    claims = claims.select("repository", "key", F.when(F.col("c") == F.col("d"), F.col("c")).otherwise(conflict).alias("component"))
    tried = F.array(*[F.struct(F.lit(i).alias("place"), F.col(c).alias("key")) for i, c in enumerate(("id", "owner_file", "path", "qualified_name", "name"))])
    asks = local.select("repository", "id", F.explode(tried).alias("t")).where("t.key <> ''").select("repository", "id", "t.place", "t.key")
    hits = asks.join(claims, ["repository", "key"]).groupBy("id").agg(F.min_by("component", "place").alias("component"))
    own = parts.select(F.col("component").alias("id"), "component").distinct()
    return own.unionByName(hits.join(own.select("id"), "id", "left_anti"))


def message_coverage(edges: DataFrame, nodes: DataFrame, package: str = "", status: str = "", component: str = "", limit: int = 1000) -> DataFrame:
    """Coverage of every canonical message, filters before the limit, by repository
    and qualified name. ``component`` keeps messages with evidence that it owns."""
    messages = canonical_messages(nodes, package)
    flows, _ = coverage(edges, nodes, messages.select("id"))
    named = messages.groupBy(F.col("id").alias("message")).agg(F.min("repository").alias("repository"), F.min("qualified_name").alias("qualified_name"))
    rows = flows.join(named, "message")
    if status:
        rows = rows.where(F.col("status") == status)
    if component:
        own = owners_by_alias(edges, nodes).where(F.col("component") == component).select(F.col("id").alias("node_id"))
        mine = evidence(edges, nodes, messages.select("id")).join(own, "node_id", "left_semi").select("message").distinct()
        rows = rows.join(mine, "message", "left_semi")
    return rows.orderBy("repository", "qualified_name", "message").limit(limit)
