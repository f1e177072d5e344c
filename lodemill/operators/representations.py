"""Derived representations: what is current, what can be reused, how complete a resource is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Kinds whose content is text, and statuses that are shown.
TEXT_KINDS = ("ocr_text", "extracted_text", "transcript_segment", "image_caption")
VISIBLE = ("current", "partial")


def visible(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("is_current") & F.col("status").isin(*VISIBLE))


def once(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row per id: the one updated last."""
    best = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct("updated_at", "created_at", *keep)).alias("r"))
    return best.select("id", "r.*")


def current_per_kind(rows: DataFrame) -> DataFrame:
    """The newest representation of each resource version and kind; registering one retires those before it."""
    newest = rows.groupBy("resource_version_id", "kind").agg(F.max(F.struct("created_at", "id", "status")).alias("r"))
    return newest.select("resource_version_id", "kind", "r.id", "r.status")


def cache_probe(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """``resource_version_id, kind, pipeline_fingerprint, id, exact``: what can be reused for a request.

    The newest row of the same resource, kind and fingerprint, else the newest of the same kind and fingerprint of
    any resource. Each side is aggregated to one row per key before the join, so a popular fingerprint is no hot key.
    """
    key = ["kind", "pipeline_fingerprint"]
    shown = rows.where(F.col("pipeline_fingerprint").isNotNull() & F.col("status").isin(*VISIBLE))
    newest = F.max(F.struct("created_at", "id"))
    own = shown.groupBy("resource_version_id", *key).agg(newest.alias("own"))
    other = shown.groupBy(*key).agg(newest.alias("any"))
    asked = wanted.select("resource_version_id", *key).distinct()
    found = asked.join(own, ["resource_version_id", *key], "left").join(other, key, "left")
    return found.select("resource_version_id", *key, F.coalesce("own.id", "any.id").alias("id"), F.col("own.id").isNotNull().alias("exact")).where(F.col("id").isNotNull())


def coverage(rows: DataFrame) -> DataFrame:
    """Per resource version the stages done of all, the share rounded half to even, and whether all are done."""
    done = F.count_if(F.col("status") == "current")
    return rows.groupBy("resource_version_id").agg(F.count("*").alias("stages"), done.alias("done"), F.bround(done / F.count("*"), 4).alias("fraction"), F.bool_and(F.col("status") == "current").alias("complete"))


def reuse(rows: DataFrame) -> DataFrame:
    """Requests, distinct runs and reused ones per kind, with their rate."""
    runs = F.countDistinct("pipeline_fingerprint")
    g = rows.groupBy("kind").agg(F.count("*").alias("requests"), runs.alias("runs"))
    saved = F.greatest(F.lit(0), F.col("requests") - F.col("runs"))
    return g.select("kind", "requests", "runs", saved.alias("reused"), F.round(F.coalesce(F.try_divide(saved, F.col("requests")), F.lit(0.0)), 6).alias("rate"))


def violations() -> dict[str, Column]:
    """The invariants of a row, by name, as columns that are true where one is broken."""
    text = F.col("kind").isin(*TEXT_KINDS)
    shown = F.col("status").isin(*VISIBLE)
    return {
        "complete_without_all": F.col("coverage_is_complete") & (F.col("coverage_fraction") != 1.0),
        "text_without_payload": text & shown & F.col("textual_payload").isNull(),
        "blob_without_hash": F.col("blob_reference").isNotNull() & F.col("blob_hash").isNull(),
        "failed_without_error": F.col("status").isin("failed", "unavailable") & F.col("error_category").isNull(),
        "updated_before_created": F.col("updated_at") < F.col("created_at"),
    }


def broken_invariants(rows: DataFrame) -> DataFrame:
    """``rule, rows``: how many distinct rows break each invariant, in one pass."""
    counts = rows.agg(*[F.countDistinct(F.when(rule, F.col("id"))).alias(name) for name, rule in violations().items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("rows")) for n in violations()])).alias("x")).select("x.rule", "x.rows")


# What a status may become. Failures and absences may be told of any.
TRANSITIONS = {"current": ("pending",), "partial": ("pending",)}


def transitioned(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """``id, status, verdict`` of ``changes(id, new_status)``: a pending row may become current or partial, any row failed or unavailable.

    Other changes are ``refused`` and leave the status, an unknown id is ``missing``. A failure or absence takes the row's
    payload from view, which is its readers' business: see :func:`visible`. Of several changes of a row the least holds.
    """
    asked = changes.groupBy("id").agg(F.min("new_status").alias("new_status"))
    both = asked.join(rows.select("id", "status"), "id", "left")
    allowed = F.col("new_status").isin("failed", "unavailable")
    for new, old in TRANSITIONS.items():
        allowed = allowed | ((F.col("new_status") == new) & F.col("status").isin(*old))
    verdict = F.when(F.col("status").isNull(), "missing").when(allowed, "changed").otherwise("refused")
    return both.select("id", F.when(verdict == "changed", F.col("new_status")).otherwise(F.col("status")).alias("status"), verdict.alias("verdict"))


def on_deletion(rows: DataFrame, deleted: DataFrame, keep: bool = True) -> DataFrame:
    """The rows after versions are deleted: theirs are current no more, or gone if history is not kept."""
    gone = deleted.select("resource_version_id").distinct()
    if not keep:
        return rows.join(gone, "resource_version_id", "left_anti")
    marked = rows.join(gone.withColumn("gone", F.lit(True)), "resource_version_id", "left")
    return marked.withColumn("is_current", F.col("is_current") & F.col("gone").isNull()).drop("gone")


def cloned(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows bound to another resource version: for what :func:`cache_probe` found elsewhere, the same content under a new id.

    The id is a hash of version, kind and the row reused, so a second run makes the same row. ``rows`` has one row per id.
    """
    elsewhere = found.where(~F.col("exact")).select(F.col("resource_version_id").alias("bound_to"), F.col("id").alias("reused"))
    source = rows.withColumnRenamed("id", "reused")
    both = elsewhere.join(source, "reused").where(F.col("bound_to") != F.col("resource_version_id"))
    new_id = F.sha2(F.concat_ws("|", "bound_to", "kind", "reused"), 256)
    return both.withColumns({"id": new_id, "resource_version_id": F.col("bound_to")}).drop("bound_to")


def coverage_reasons(stages: DataFrame) -> DataFrame:
    """``resource_version_id, complete, fraction, reason`` of ``stages(resource_version_id, stage, status, whole)``.

    A stage is done by success, or by a cache hit that was whole. What is not done is named by status and stage in order
    of the stages' names.
    """
    done = (F.col("status") == "success") | ((F.col("status") == "cache_hit") & F.col("whole"))
    names = {s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("stage")))) for s in ("failed", "cancelled", "partial")}
    g = stages.groupBy("resource_version_id").agg(F.count("*").alias("n"), F.count_if(done).alias("done"), *[c.alias(s) for s, c in names.items()])
    told = F.concat_ws("; ", *[F.when(F.size(s) > 0, F.concat(F.lit(f"{s}: "), F.array_join(s, ", "))) for s in names])
    whole = F.col("done") == F.col("n")
    return g.select("resource_version_id", whole.alias("complete"), F.when(whole, 1.0).otherwise(F.bround(F.col("done") / F.col("n"), 4)).alias("fraction"), F.when(whole, "all stages complete").when(told == "", "incomplete").otherwise(told).alias("reason"))


def enrichments_put(cache: DataFrame, results: DataFrame) -> DataFrame:
    """The cache with results put, errors as well: the last by ``at`` of each content and fingerprint holds.

    Both have ``content_hash, fingerprint, status, extraction, error, at``.
    """
    both = cache.unionByName(results).where(F.col("content_hash").isNotNull() & F.col("fingerprint").isNotNull())
    last = both.groupBy("content_hash", "fingerprint").agg(F.max(F.struct("at", "status", "extraction", "error")).alias("r"))
    return last.select("content_hash", "fingerprint", "r.status", "r.extraction", "r.error", "r.at")


def enrichment_probe(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """``asked`` with ``extraction`` and ``hit``; an error on record is no hit."""
    good = cache.where(F.col("status") == "success").select("content_hash", "fingerprint", "extraction", F.lit(True).alias("hit"))
    return asked.join(good, ["content_hash", "fingerprint"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def history(rows: DataFrame, most: int = 10) -> DataFrame:
    """``resource_version_id, kind, place, id, status``: the newest rows of each version and kind, ``most`` at most."""
    order = Window.partitionBy("resource_version_id", "kind").orderBy(F.desc_nulls_last("created_at"), "id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("resource_version_id", "kind", "place", "id", "status")


def available_routes(rows: DataFrame, enabled: dict[str, tuple[str, ...]]) -> DataFrame:
    """``route, rows``: the enabled routes that have something to search: shown rows of one of their kinds."""
    shown = rows.where(F.col("status").isin(*VISIBLE))
    found = F.array_compact(F.array(*[F.when(F.col("kind").isin(*kinds), F.lit(route)) for route, kinds in enabled.items()]))
    return shown.select(F.explode(found).alias("route")).groupBy("route").agg(F.count("*").alias("rows"))
