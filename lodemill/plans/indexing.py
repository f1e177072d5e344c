"""Batches of indexing, joins over time and composite reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.functions import text as t
from lodemill.operators import chunking, events, joins, media, records
from lodemill.plans import changefeed, state
from lodemill.session import table

# Pipelines by name, mime glob and kind, first match first.
REGISTRY = [
    ("ocr", "image/*", "ocr_text"),
    ("pdf_text", "application/pdf", "extracted_text"),
    ("any_text", "*", "extracted_text"),
    ("scan", "text/*", "ocr_text"),
    ("speech", "audio/*", "transcript_segment"),
    ("plain_speech", "text/plain", "transcript_segment"),
    ("header", "application/json", "metadata"),
    ("frames", "*", "keyframe"),
]


def index_batch(spark, sf_dir) -> DataFrame:
    """What a run over the documents records: hash, status and chunks; blank texts are errors.

    The texts are read once for the hash and once, only where there is work, for the chunks.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    status = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "error").otherwise("indexed")
    rows = d.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), status.alias("status"))
    chunks = chunking.chunked(d, 512, 64, "doc_id").groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))
    return rows.join(chunks, "doc_id", "left").select("doc_id", "content_hash", "status", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def index_hashes(spark, sf_dir) -> DataFrame:
    """Documents by content: how many ids share a text, and the least of them."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first"))


def index_work(spark, sf_dir) -> DataFrame:
    """Documents still to be indexed when those of the first half of the texts' hashes are known."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    known = d.where(F.col("content_hash") < "8").withColumn("status", F.lit("indexed"))
    return records.work_list(d, known).select("id", "content_hash")


def pipelines_resolved(spark, sf_dir) -> DataFrame:
    return joins.resolve_by_pattern(table(spark, sf_dir, "representations").select(F.col("media_type").alias("mime"), "kind"), REGISTRY)


def fingerprints(spark, sf_dir) -> DataFrame:
    r = table(spark, sf_dir, "representations").where(F.col("id").isNotNull()).select("id", "adapter_name", "kind", "media_type").distinct()
    return r.select("id", t.digest(F.col("adapter_name"), F.col("kind"), F.col("media_type")).alias("digest"))


def last_view(spark, sf_dir) -> DataFrame:
    """Each purchase with the last view of its user before it."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    views, bought = e.where("event_type = 'view'"), e.where("event_type = 'purchase'")
    return joins.as_of(bought, views, "user_id", "us", "event_id", 5 * 86_400_000_000).withColumnRenamed("event_id", "view_id")


def dependency_findings(spark, sf_dir) -> DataFrame:
    """Whether the path on record of each resource is still its path; deleted ones are expected to have none."""
    latest = events.latest_per_key(table(spark, sf_dir, "resources"), "id", ["last_sequence", "state_version"], ["status", "current_path"])
    wanted = latest.select("id", F.when(F.col("status") != "deleted", F.col("current_path")).alias("expected"))
    now = changefeed.p5_state(spark, sf_dir).where(F.col("status") != "deleted").select(F.col("resource_id").alias("id"), F.col("current_path").alias("actual"))
    return joins.dependency_status(wanted, now)


def edges_between_records(spark, sf_dir) -> DataFrame:
    """Distinct duplicates whose target is on record."""
    files = table(spark, sf_dir, "files").select(F.col("id").alias("dst")).distinct()
    return table(spark, sf_dir, "duplicates").select("src", "dst").distinct().join(files, "dst", "left_semi").select("src", "dst")


def correlated_changes(spark, sf_dir) -> DataFrame:
    """Events by what caused them: count, resources, first and last sequence."""
    e = table(spark, sf_dir, "workspace_events").where(F.col("correlation_id").isNotNull()).groupBy("workspace_id", "sequence").agg(F.max("correlation_id").alias("correlation_id"), F.max("resource_id").alias("resource_id"))
    return e.groupBy("correlation_id").agg(F.count("*").alias("events"), F.countDistinct("resource_id").alias("resources"), F.min("sequence").alias("first"), F.max("sequence").alias("last"))


def reconcile_actions(spark, sf_dir) -> DataFrame:
    """What an observer does on each event: a full scan after a gap, else by whether an operation of its own caused it."""
    e = table(spark, sf_dir, "workspace_events").groupBy("workspace_id", "sequence").agg(F.max("correlation_id").alias("correlation_id"))
    gaps = events.gaps(e).select("workspace_id", F.col("current").alias("sequence"), F.lit(True).alias("gap"))
    both = e.join(gaps, ["workspace_id", "sequence"], "left")
    action = F.when(F.col("gap"), "full_scan").when(F.col("correlation_id").isNull(), "external").otherwise("governed")
    return both.groupBy("workspace_id", action.alias("action")).agg(F.count("*").alias("events"))


def recovery_stats(spark, sf_dir) -> DataFrame:
    """Stored blobs by kind: rows, bytes, those past their retention, and what sharing saves."""
    r = table(spark, sf_dir, "representations").where(F.col("blob_hash").isNotNull() & F.col("id").isNotNull()).select("id", "kind", "blob_hash", "blob_byte_count", "created_at").distinct()
    late = F.col("created_at") <= F.lit("2025-06-01").cast("timestamp")
    g = r.groupBy("kind").agg(F.count("*").alias("rows"), F.sum("blob_byte_count").alias("bytes"), F.count_if(late).alias("expired"), F.countDistinct("blob_hash").alias("blobs"))
    return g.select("kind", "rows", "bytes", "expired", "blobs", (F.col("rows") - F.col("blobs")).alias("shared"))


def workspace_brief(spark, sf_dir) -> DataFrame:
    """One row per workspace: last sequence, items included and omitted, bytes used, rows that projections lag behind."""
    fit = state.brief_fit(spark, sf_dir).groupBy("workspace_id").agg(F.count_if("included").alias("included"), F.count_if(~F.col("included")).alias("omitted"), F.sum(F.when(F.col("included"), F.col("cost")).otherwise(0)).alias("bytes_used"))
    last = events.next_sequence(table(spark, sf_dir, "workspace_events")).select("workspace_id", "last_sequence")
    lag = state.projection_freshness(spark, sf_dir).groupBy("workspace_id").agg(F.sum("lag").alias("lag"))
    return last.join(fit, "workspace_id", "left").join(lag, "workspace_id", "left")


def media_dimensions(spark, sf_dir) -> DataFrame:
    """Image headers made of the sizes that metadata tells, read back by the header's own format."""
    m = table(spark, sf_dir, "representations").where((F.col("kind") == "metadata") & F.col("id").isNotNull()).select("id", F.from_json("textual_payload", "struct<width:int,height:int>").alias("m")).where(F.col("m.width").isNotNull() & F.col("m.height").isNotNull()).distinct()
    wide = lambda c: F.lpad(F.hex(F.col(c)), 8, "0")
    header = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), wide("m.width"), wide("m.height"), F.lit("0806000000")))
    rows = m.select("id", header.alias("content"))
    size = media.dimensions(F.col("content"))
    return rows.select("id", media.media_type(F.col("content")).alias("media_type"), size["width"].alias("width"), size["height"].alias("height"))


QUERIES = {f.__name__: f for f in (index_batch, index_hashes, index_work, pipelines_resolved, fingerprints, last_view, dependency_findings, edges_between_records, correlated_changes, reconcile_actions, recovery_stats, workspace_brief, media_dimensions)}

_LATEST = "latest AS (SELECT * FROM resources WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_sequence DESC NULLS LAST, state_version DESC NULLS LAST, status DESC NULLS LAST, current_path DESC NULLS LAST) = 1)"
SQL = {
    "index_hashes": "SELECT sha256(text) AS content_hash, count(*) AS documents, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "index_work": "SELECT doc_id AS id, sha256(coalesce(text, '')) AS content_hash FROM documents WHERE sha256(coalesce(text, '')) >= '8'",
    "pipelines_resolved": """SELECT DISTINCT mime, kind, pipeline FROM (SELECT media_type AS mime, kind, CASE
WHEN kind = 'ocr_text' AND media_type LIKE 'image/%' THEN 'ocr' WHEN kind = 'extracted_text' AND media_type = 'application/pdf' THEN 'pdf_text' WHEN kind = 'extracted_text' AND media_type IS NOT NULL THEN 'any_text'
WHEN kind = 'ocr_text' AND media_type LIKE 'text/%' THEN 'scan' WHEN kind = 'transcript_segment' AND media_type LIKE 'audio/%' THEN 'speech' WHEN kind = 'transcript_segment' AND media_type = 'text/plain' THEN 'plain_speech'
WHEN kind = 'metadata' AND media_type = 'application/json' THEN 'header' WHEN kind = 'keyframe' AND media_type IS NOT NULL THEN 'frames' END AS pipeline FROM representations) WHERE pipeline IS NOT NULL""",
    "fingerprints": """SELECT DISTINCT id, sha256('{"adapter_name":' || coalesce('"' || adapter_name || '"', 'null') || ',"kind":' || coalesce('"' || kind || '"', 'null') || ',"media_type":' || coalesce('"' || media_type || '"', 'null') || '}') AS digest FROM representations WHERE id IS NOT NULL""",
    "last_view": "WITH v AS (SELECT user_id, epoch_us(ts) AS us, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) SELECT p.user_id, epoch_us(p.ts) AS us, v.view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND epoch_us(p.ts) >= v.us",
    "dependency_findings": f"""WITH {_LATEST}, w AS (SELECT id, CASE WHEN status <> 'deleted' THEN current_path END AS expected FROM latest), n AS (SELECT resource_id, current_path AS actual FROM ({changefeed.SQL["p5_state"]}) WHERE status <> 'deleted')
SELECT id, expected, actual, CASE WHEN expected IS NULL THEN CASE WHEN resource_id IS NULL THEN 'ok' ELSE 'unexpected' END WHEN resource_id IS NULL THEN 'missing' WHEN expected IS NOT DISTINCT FROM actual THEN 'ok' ELSE 'mismatch' END AS finding FROM w LEFT JOIN n ON n.resource_id = w.id""",
    "edges_between_records": "SELECT DISTINCT src, dst FROM duplicates WHERE dst IN (SELECT id FROM files)",
    "correlated_changes": "SELECT correlation_id, count(*) AS events, count(DISTINCT resource_id) AS resources, min(sequence) AS first, max(sequence) AS last FROM (SELECT workspace_id, sequence, max(correlation_id) AS correlation_id, max(resource_id) AS resource_id FROM workspace_events WHERE correlation_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
    "reconcile_actions": "WITH e AS (SELECT workspace_id, sequence, max(correlation_id) AS c FROM workspace_events GROUP BY 1, 2), g AS (SELECT *, sequence <> lag(sequence) OVER (PARTITION BY workspace_id ORDER BY sequence) + 1 AS gap FROM e) SELECT workspace_id, CASE WHEN gap THEN 'full_scan' WHEN c IS NULL THEN 'external' ELSE 'governed' END AS action, count(*) AS events FROM g GROUP BY 1, 2",
    "recovery_stats": "SELECT kind, count(*) AS rows, sum(blob_byte_count)::bigint AS bytes, count(*) FILTER (created_at <= timestamptz '2025-06-01 00:00:00+00') AS expired, count(DISTINCT blob_hash) AS blobs, count(*) - count(DISTINCT blob_hash) AS shared FROM (SELECT DISTINCT id, kind, blob_hash, blob_byte_count, created_at FROM representations WHERE blob_hash IS NOT NULL AND id IS NOT NULL) GROUP BY 1",
    "media_dimensions": "SELECT DISTINCT id, 'image/png' AS media_type, CAST(json_extract(textual_payload, '$.width') AS BIGINT) AS width, CAST(json_extract(textual_payload, '$.height') AS BIGINT) AS height FROM representations WHERE kind = 'metadata' AND id IS NOT NULL AND json_valid(textual_payload) AND json_extract(textual_payload, '$.width') IS NOT NULL AND json_extract(textual_payload, '$.height') IS NOT NULL",
    "workspace_brief": f"""SELECT workspace_id, last_sequence, included, omitted, bytes_used, lag FROM ({state.SQL["event_next_sequence"]})
LEFT JOIN (SELECT workspace_id, count(*) FILTER (included) AS included, count(*) FILTER (NOT included) AS omitted, sum(CASE WHEN included THEN cost ELSE 0 END)::bigint AS bytes_used FROM ({state.SQL["brief_fit"]}) GROUP BY 1) USING (workspace_id)
LEFT JOIN (SELECT workspace_id, sum(lag)::bigint AS lag FROM ({state.SQL["projection_freshness"]}) GROUP BY 1) USING (workspace_id)""",
}
