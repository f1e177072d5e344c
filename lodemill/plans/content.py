"""Files, chunks, representations and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodemill.functions import text as t
from lodemill.operators import chunking, evaluation, records, representations
from lodemill.plans import changefeed
from lodemill.plans.binding import LATEST_FILES
from lodemill.session import table

GLOBS = ["**/*.md", "*.pdf", "/vault/t*/*", "audit_?*_[0-9]*.json"]


def _files(spark, sf_dir, *keep: str) -> DataFrame:
    return records.latest_files(table(spark, sf_dir, "files"), list(keep))


def files_latest(spark, sf_dir) -> DataFrame:
    return _files(spark, sf_dir).select("id", "path", "status", "content_hash", "size_bytes")


def files_by_status(spark, sf_dir) -> DataFrame:
    return records.count_by_status(_files(spark, sf_dir))


def files_work_list(spark, sf_dir) -> DataFrame:
    return records.work_list(_files(spark, sf_dir), table(spark, sf_dir, "files")).select("id", "content_hash", "status")


def files_status_page(spark, sf_dir) -> DataFrame:
    """One row about all files and chunks: two aggregates laid on top of each other, each null where the other tells."""
    names = ["files", "indexed", "failed", "bytes", "waiting", "last_indexed", "chunks"]
    f = _files(spark, sf_dir).agg(F.count("*").alias("files"), F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(F.col("status") == "error").alias("failed"), F.sum("size_bytes").alias("bytes"), F.bool_or(F.col("last_indexed_at").isNull()).alias("waiting"), F.unix_micros(F.max("last_indexed_at")).alias("last_indexed"))
    c = table(spark, sf_dir, "chunks").agg(F.countDistinct("id").alias("chunks"))
    return f.unionByName(c, allowMissingColumns=True).agg(*[F.max(n).alias(n) for n in names])


def files_matching(spark, sf_dir) -> DataFrame:
    return _files(spark, sf_dir).where(t.matches_any(F.col("path"), GLOBS)).select("id", "path")


def files_within(spark, sf_dir) -> DataFrame:
    return _files(spark, sf_dir).where(t.is_within(F.col("path"), F.lit("/vault/kettle/")) | t.is_within(F.col("path"), F.lit("/vault/tariff"))).select("id", "path")


def files_names(spark, sf_dir) -> DataFrame:
    return _files(spark, sf_dir).select("id", t.base_name(F.col("path")).alias("name"), t.extension(F.col("path")).alias("suffix"), F.sha2("path", 256).alias("path_hash"))


def chunks_publishable(spark, sf_dir) -> DataFrame:
    return records.publishable(table(spark, sf_dir, "chunks").select("id", "file_id").distinct(), _files(spark, sf_dir))


def chunks_after_deletion(spark, sf_dir) -> DataFrame:
    gone = _files(spark, sf_dir).where(F.col("status") == "deleted").select("id")
    return records.delete_keys(table(spark, sf_dir, "chunks").select("id", "file_id").distinct(), gone, "file_id").groupBy("file_id").agg(F.count("*").alias("chunks"))


def chunks_replaced(spark, sf_dir) -> DataFrame:
    """Files whose first chunk is a stub are chunked anew as one chunk."""
    old = table(spark, sf_dir, "chunks").select("id", "file_id", "ordinal").distinct()
    stub = table(spark, sf_dir, "chunks").where((F.col("ordinal") == 0) & (F.length("text") < 40)).select("id", "file_id", "ordinal").distinct()
    return records.replace_by_key(old, stub, "file_id").groupBy("file_id").agg(F.count("*").alias("chunks"), F.max("ordinal").alias("last"))


def chunks_with_vectors(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "chunks")
    texts = c.where(F.col("text").isNotNull()).select("id", F.length("text").alias("chars")).distinct()
    vectors = c.where(F.col("vector").isNotNull()).select("id", F.size("vector").alias("size")).distinct()
    return texts.join(vectors, "id")


def chunk_tokens(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "chunks").where(F.col("text").isNotNull()).select("id", "text").distinct()
    return c.select("id", t.estimate_tokens(F.col("text")).alias("tokens"), t.chunk_cost(F.col("text")).alias("cost"), t.preview_cost(F.col("text")).alias("preview"))


def chunk_previews(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "chunks").where(F.col("text").isNotNull()).select("id", "text").distinct()
    return c.select("id", t.bounded_preview(F.col("text"), 80).alias("preview"))


def document_redactions(spark, sf_dir) -> DataFrame:
    """Source names stand for secrets behind a key word, so that every document has one."""
    text = F.concat(F.lit("api_key: "), F.lower(F.trim("source")), F.lit(" | "), "text")
    d = table(spark, sf_dir, "documents").where(F.col("source").isNotNull() & F.col("text").isNotNull())
    return d.select("doc_id", F.length(t.redact_secrets(text)).alias("chars"), F.contains(t.redact_secrets(text), F.lit(t.REDACTED)).alias("redacted"))


def document_chunks(spark, sf_dir) -> DataFrame:
    return chunking.chunked(table(spark, sf_dir, "documents"), 128, 16, "doc_id").select("doc_id", "ordinal", "tokens", F.length("text").alias("chars"))


def duplicate_text_scores(spark, sf_dir) -> DataFrame:
    """How alike the summaries of linked files are."""
    f = _files(spark, sf_dir, "summary").where(F.col("summary").isNotNull()).select("id", t.word_list(F.lower("summary")).alias("w"))
    pairs = table(spark, sf_dir, "duplicates").where(F.col("src") < F.col("dst")).select("src", "dst").distinct()
    both = pairs.join(f.select(F.col("id").alias("src"), F.col("w").alias("a")), "src").join(f.select(F.col("id").alias("dst"), F.col("w").alias("b")), "dst")
    return both.select("src", "dst", F.round(t.positional_accuracy(F.col("a"), F.col("b")), 6).alias("positional"), F.round(t.token_f1(F.col("a"), F.col("b")), 6).alias("f1"))


def duplicate_error_rates(spark, sf_dir) -> DataFrame:
    f = _files(spark, sf_dir, "summary").where(F.col("summary").isNotNull()).select("id", "summary")
    pairs = table(spark, sf_dir, "duplicates").where(F.col("src") < F.col("dst")).select("src", "dst").distinct()
    both = pairs.join(f.select(F.col("id").alias("src"), F.col("summary").alias("a")), "src").join(f.select(F.col("id").alias("dst"), F.col("summary").alias("b")), "dst")
    return both.select("src", "dst", F.round(t.character_error_rate(F.col("a"), F.col("b")), 6).alias("error_rate"))


def _reps(spark, sf_dir) -> DataFrame:
    keep = ["resource_version_id", "kind", "status", "is_current", "confidence", "pipeline_fingerprint", "blob_hash", "blob_byte_count", "coverage_fraction"]
    return representations.once(table(spark, sf_dir, "representations"), keep)


def representation_visible(spark, sf_dir) -> DataFrame:
    return representations.visible(_reps(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("rows"), F.round(F.avg("confidence"), 6).alias("confidence"))


def representation_current(spark, sf_dir) -> DataFrame:
    return representations.current_per_kind(_reps(spark, sf_dir))


def representation_cache(spark, sf_dir) -> DataFrame:
    r = _reps(spark, sf_dir)
    return representations.cache_probe(r.where(F.col("status").isin("failed", "partial", "stale")), r)


def representation_coverage(spark, sf_dir) -> DataFrame:
    return representations.coverage(_reps(spark, sf_dir))


def representation_reuse(spark, sf_dir) -> DataFrame:
    return representations.reuse(_reps(spark, sf_dir))


def representation_invariants(spark, sf_dir) -> DataFrame:
    return representations.broken_invariants(table(spark, sf_dir, "representations"))


def blob_stats(spark, sf_dir) -> DataFrame:
    b = records.blob_rows(table(spark, sf_dir, "representations"))
    return b.agg(F.count("*").alias("blobs"), F.sum("byte_count").alias("bytes"), F.sum("references").alias("references"), F.count_if(F.col("references") > 1).alias("shared"))


def blob_paths(spark, sf_dir) -> DataFrame:
    b = records.blob_rows(table(spark, sf_dir, "representations"))
    return b.select("hash", records.blob_path(F.col("hash")).alias("path"), "references")


def blob_unreferenced(spark, sf_dir) -> DataFrame:
    return records.unreferenced_blobs(table(spark, sf_dir, "representations")).select("hash", "byte_count")


def retrieval_quality(spark, sf_dir) -> DataFrame:
    """The twenty resources of each workspace recorded last, as what a search returns, against all that are current in the feed."""
    rows = table(spark, sf_dir, "resources").where(F.col("id").isNotNull())
    latest = rows.groupBy("workspace_id", "id").agg(F.max("last_sequence").alias("s"))
    returned = latest.withColumn("place", F.row_number().over(Window.partitionBy("workspace_id").orderBy(F.desc("s"), "id"))).where(F.col("place") <= 20)
    known = rows.select("workspace_id", "id").unionByName(table(spark, sf_dir, "workspace_events").select("workspace_id", F.col("resource_id").alias("id"))).where(F.col("id").isNotNull() & F.col("workspace_id").isNotNull()).distinct()
    current = changefeed.p5_found(spark, sf_dir).select(F.col("resource_id").alias("id"))
    q = evaluation.recall_by_counts(returned.select(F.col("workspace_id").alias("query"), "id", "place"), known.join(current, "id", "left_semi").select(F.col("workspace_id").alias("query"), "id"), 5)
    return q.select(F.col("query").alias("workspace_id"), "expected", F.round("recall", 6).alias("recall"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


def best_adapters(spark, sf_dir) -> DataFrame:
    r = table(spark, sf_dir, "representations").where(F.col("confidence").isNotNull() & F.col("adapter_name").isNotNull())
    scores = r.select(F.col("kind").alias("metric"), F.col("adapter_name").alias("adapter"), F.col("resource_version_id").alias("case"), F.col("confidence").alias("value"))
    return evaluation.best_adapter(scores).select("metric", "adapter", F.round("mean", 6).alias("mean"))


QUERIES = {f.__name__: f for f in (files_latest, files_by_status, files_work_list, files_status_page, files_matching, files_within, files_names, chunks_publishable, chunks_after_deletion, chunks_replaced, chunks_with_vectors, chunk_tokens, chunk_previews, document_redactions, document_chunks, duplicate_text_scores, duplicate_error_rates, representation_visible, representation_current, representation_cache, representation_coverage, representation_reuse, representation_invariants, blob_stats, blob_paths, blob_unreferenced, retrieval_quality, best_adapters)}

_SP = r"[\x{0009}-\x{000d}\x{001c}-\x{0020}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_L = f"WITH {LATEST_FILES}"
_REPS = "reps AS (SELECT id, resource_version_id, kind, status, is_current, confidence, pipeline_fingerprint, created_at FROM representations WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST) = 1)"
_WORDS = f"""w AS (SELECT id, list_transform(list_filter(string_split(trim(regexp_replace(lower(summary), '{_SP}+', ' ', 'g')), ' '), lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(x, '^[.,!?;:"''()\\[\\]{{}}]+', ''), '[.,!?;:"''()\\[\\]{{}}]+$', '')) AS w FROM latest_files WHERE summary IS NOT NULL)"""
SQL = {
    "files_latest": f"{_L} SELECT id, path, status, content_hash, size_bytes FROM latest_files",
    "files_by_status": f"{_L} SELECT coalesce(status, 'pending') AS status, count(*) AS files FROM latest_files GROUP BY 1",
    "files_work_list": f"{_L} SELECT id, content_hash, status FROM latest_files l WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.status = 'indexed' AND f.id = l.id AND f.content_hash = l.content_hash)",
    "files_status_page": f"{_L} SELECT count(*) AS files, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'error') AS failed, sum(size_bytes)::bigint AS bytes, bool_or(last_indexed_at IS NULL) AS waiting, epoch_us(max(last_indexed_at)) AS last_indexed, (SELECT count(DISTINCT id) FROM chunks) AS chunks FROM latest_files",
    "files_matching": f"{_L} SELECT id, path FROM latest_files WHERE path GLOB '*/*.md' OR path GLOB '*.pdf' OR regexp_full_match(path, '/vault/t.*/.*', 's') OR regexp_full_match(string_split(path, '/')[-1], 'audit_..*_[0-9].*\\.json')",
    "files_within": f"{_L} SELECT id, path FROM latest_files WHERE starts_with(path, '/vault/kettle/') OR starts_with(path, '/vault/tariff/')",
    "files_names": f"{_L} SELECT id, string_split(path, '/')[-1] AS name, lower(regexp_extract(string_split(path, '/')[-1], '(\\.[^./]+)$', 1)) AS suffix, sha256(path) AS path_hash FROM latest_files",
    "chunks_publishable": f"{_L} SELECT DISTINCT id, file_id FROM chunks WHERE file_id IN (SELECT id FROM latest_files WHERE status IN ('indexed', 'stale'))",
    "chunks_after_deletion": f"{_L} SELECT file_id, count(*) AS chunks FROM (SELECT DISTINCT id, file_id FROM chunks) c WHERE NOT EXISTS (SELECT 1 FROM latest_files l WHERE l.status = 'deleted' AND l.id = c.file_id) GROUP BY 1",
    "chunks_replaced": "WITH o AS (SELECT DISTINCT id, file_id, ordinal FROM chunks), s AS (SELECT DISTINCT id, file_id, ordinal FROM chunks WHERE ordinal = 0 AND length(text) < 40) SELECT file_id, count(*) AS chunks, max(ordinal) AS last FROM (SELECT * FROM o WHERE file_id NOT IN (SELECT file_id FROM s) UNION ALL SELECT * FROM s) GROUP BY 1",
    "chunks_with_vectors": "SELECT id, chars, size FROM (SELECT DISTINCT id, length(text) AS chars FROM chunks WHERE text IS NOT NULL) JOIN (SELECT DISTINCT id, len(vector) AS size FROM chunks WHERE vector IS NOT NULL) USING (id)",
    "chunk_tokens": f"SELECT DISTINCT id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(regexp_replace(text, '{_SP}', '', 'g')) // 3) END AS tokens, greatest(1, length(text) // 4) AS cost, (length(text) + 3) // 4 AS preview FROM chunks WHERE text IS NOT NULL",
    "chunk_previews": f"SELECT DISTINCT id, CASE WHEN length(p) <= 80 THEN p ELSE rtrim(substring(p, 1, 79)) || '…' END AS preview FROM (SELECT id, trim(regexp_replace(text, '{_SP}+', ' ', 'g')) AS p FROM chunks WHERE text IS NOT NULL)",
    "document_redactions": "SELECT doc_id, 12 + length(text) + CASE WHEN length(lower(trim(source))) >= 8 THEN length('***REDACTED***') ELSE length(lower(trim(source))) END AS chars, length(lower(trim(source))) >= 8 AS redacted FROM documents WHERE source IS NOT NULL AND text IS NOT NULL",
    "duplicate_text_scores": f"""{_L}, {_WORDS}, p AS (SELECT DISTINCT src, dst FROM duplicates WHERE src < dst),
b AS (SELECT src, dst, x.w AS a, y.w AS b FROM p JOIN w x ON x.id = src JOIN w y ON y.id = dst)
SELECT src, dst, round(CASE WHEN greatest(len(a), len(b)) = 0 THEN 1 ELSE len(list_filter(list_zip(a, b, true), lambda z: z[1] = z[2]))::double / greatest(len(a), len(b)) END, 6) AS positional,
  round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 WHEN len(list_intersect(list_distinct(a), list_distinct(b))) = 0 THEN 0 ELSE 2.0::double * len(list_intersect(list_distinct(a), list_distinct(b))) / (len(list_distinct(a)) + len(list_distinct(b))) END, 6) AS f1 FROM b""",
    "representation_visible": f"WITH {_REPS} SELECT kind, count(*) AS rows, round(avg(confidence), 6) AS confidence FROM reps WHERE is_current AND status IN ('current', 'partial') GROUP BY 1",
    "representation_current": f"WITH {_REPS} SELECT resource_version_id, kind, id, status FROM reps QUALIFY row_number() OVER (PARTITION BY resource_version_id, kind ORDER BY created_at DESC NULLS LAST, id DESC) = 1",
    "representation_cache": f"""WITH {_REPS}, s AS (SELECT * FROM reps WHERE pipeline_fingerprint IS NOT NULL AND status IN ('current', 'partial')),
o AS (SELECT resource_version_id, kind, pipeline_fingerprint, arg_max(id, (created_at, id)) AS id FROM s GROUP BY 1, 2, 3), a AS (SELECT kind, pipeline_fingerprint, arg_max(id, (created_at, id)) AS id FROM s GROUP BY 1, 2),
q AS (SELECT DISTINCT resource_version_id, kind, pipeline_fingerprint FROM reps WHERE status IN ('failed', 'partial', 'stale'))
SELECT resource_version_id, kind, pipeline_fingerprint, coalesce(o.id, a.id) AS id, o.id IS NOT NULL AS exact FROM q LEFT JOIN o USING (resource_version_id, kind, pipeline_fingerprint) LEFT JOIN a USING (kind, pipeline_fingerprint) WHERE coalesce(o.id, a.id) IS NOT NULL""",
    "representation_coverage": f"WITH {_REPS} SELECT resource_version_id, count(*) AS stages, count(*) FILTER (status = 'current') AS done, round_even(count(*) FILTER (status = 'current')::double / count(*), 4) AS fraction, bool_and(status = 'current') AS complete FROM reps GROUP BY 1",
    "representation_reuse": f"WITH {_REPS} SELECT kind, count(*) AS requests, count(DISTINCT pipeline_fingerprint) AS runs, greatest(0, count(*) - count(DISTINCT pipeline_fingerprint)) AS reused, round(greatest(0, count(*) - count(DISTINCT pipeline_fingerprint))::double / count(*), 6) AS rate FROM reps GROUP BY 1",
    "representation_invariants": """SELECT 'complete_without_all' AS rule, count(DISTINCT id) FILTER (coverage_is_complete AND coverage_fraction <> 1.0) AS rows FROM representations
UNION ALL SELECT 'text_without_payload', count(DISTINCT id) FILTER (kind IN ('ocr_text', 'extracted_text', 'transcript_segment', 'image_caption') AND status IN ('current', 'partial') AND textual_payload IS NULL) FROM representations
UNION ALL SELECT 'blob_without_hash', count(DISTINCT id) FILTER (blob_reference IS NOT NULL AND blob_hash IS NULL) FROM representations
UNION ALL SELECT 'failed_without_error', count(DISTINCT id) FILTER (status IN ('failed', 'unavailable') AND error_category IS NULL) FROM representations
UNION ALL SELECT 'updated_before_created', count(DISTINCT id) FILTER (updated_at < created_at) FROM representations""",
    "blob_stats": "SELECT count(*) AS blobs, sum(b)::bigint AS bytes, sum(r)::bigint AS references, count(*) FILTER (r > 1) AS shared FROM (SELECT blob_hash, max(blob_byte_count) AS b, count(DISTINCT id) AS r FROM representations WHERE blob_hash IS NOT NULL GROUP BY 1)".replace("AS references", 'AS "references"'),
    "blob_paths": "SELECT blob_hash AS hash, substring(blob_hash, 1, 2) || '/' || substring(blob_hash, 3, 2) || '/' || blob_hash AS path, count(DISTINCT id) AS \"references\" FROM representations WHERE blob_hash IS NOT NULL GROUP BY 1",
    "blob_unreferenced": "SELECT blob_hash AS hash, max(blob_byte_count) AS byte_count FROM representations WHERE blob_hash IS NOT NULL GROUP BY 1 HAVING NOT coalesce(bool_or(is_current), false)",
    "retrieval_quality": f"""WITH l AS (SELECT workspace_id, id, max(last_sequence) AS s FROM resources WHERE id IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY s DESC, id) AS n FROM l QUALIFY n <= 20),
k AS (SELECT workspace_id, id FROM resources UNION SELECT workspace_id, resource_id FROM workspace_events),
e AS (SELECT k.* FROM k WHERE workspace_id IS NOT NULL AND id IN (SELECT resource_id FROM ({changefeed.SQL["p5_found"]})))
SELECT e.workspace_id, count(*) AS expected, round(count(r.n) FILTER (n <= 5)::double / count(*), 6) AS recall, round(coalesce(1.0::double / min(n), 0), 6) AS reciprocal_rank FROM e LEFT JOIN r ON r.workspace_id = e.workspace_id AND r.id = e.id GROUP BY 1""",
    "duplicate_error_rates": f"""{_L}, f AS (SELECT id, summary FROM latest_files WHERE summary IS NOT NULL)
SELECT DISTINCT src, dst, round(CASE WHEN greatest(length(a.summary), length(b.summary)) = 0 THEN 0 ELSE levenshtein(a.summary, b.summary)::double / greatest(length(a.summary), length(b.summary)) END, 6) AS error_rate
FROM duplicates JOIN f a ON a.id = src JOIN f b ON b.id = dst WHERE src < dst""",
    "best_adapters": "WITH c AS (SELECT kind, adapter_name, resource_version_id, avg(confidence) AS v FROM representations WHERE confidence IS NOT NULL AND adapter_name IS NOT NULL GROUP BY 1, 2, 3), m AS (SELECT kind, adapter_name, avg(v) AS mean FROM c GROUP BY 1, 2) SELECT kind AS metric, arg_max(adapter_name, mean) AS adapter, round(max(mean), 6) AS mean FROM m GROUP BY 1",
}
