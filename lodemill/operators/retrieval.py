"""Evidence, scores and ranks of files, and the context assembled from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodemill.functions.text import base_name, chunk_cost
from lodemill.operators import graph, vectors


# What each kind of evidence adds to a score, and the bounds of sums and scores.
@dataclass(frozen=True)
class Weights:
    similar: float = 0.50
    per_entity: float = 0.12
    most_entities: float = 0.30
    per_topic: float = 0.08
    most_topics: float = 0.20
    cited: float = 0.25
    copied: float = -0.05
    lowest: float = 0.0
    highest: float = 1.0


QUANTUM = 1e-6


def connector_evidence(hops: DataFrame) -> DataFrame:
    """Per peer the sums and counts of shared connectors, references and the highest similarity of a duplicate.

    A connector met through two files of the frontier counts twice. The sums are partial before the shuffle, so a
    connector that many files share costs no more than its rows.
    """
    of = lambda via: F.col("via") == via
    return hops.groupBy("peer").agg(
        F.sum(F.when(of("mentioned-entity"), F.col("weight"))).alias("entity_weight"),
        F.count_if(of("mentioned-entity")).alias("entities"),
        F.sum(F.when(of("shared-topic"), F.col("weight"))).alias("topic_weight"),
        F.count_if(of("shared-topic")).alias("topics"),
        F.count_if(of("references")).alias("citations"),
        F.max(F.when(of("duplicate"), F.col("weight"))).alias("duplicate_similarity"),
        # A peer has no more connectors than edges of its own.
        F.slice(F.array_sort(F.collect_set(F.when(of("mentioned-entity"), F.col("name")))), 1, 3).alias("entity_names"),
        F.slice(F.array_sort(F.collect_set(F.when(of("shared-topic"), F.col("name")))), 1, 3).alias("topic_names"),
    )


def capped(per: float, cap: float, weight: Column) -> Column:
    return F.least(F.lit(cap), F.lit(per) * weight)


def contributions(candidates: DataFrame, w: Weights) -> DataFrame:
    """Adds a column per kind of evidence (null where it did not fire), ``evidence_count`` and ``score``."""
    out = candidates.select(
        "*",
        F.when(F.col("similarity") > 0, F.lit(w.similar) * F.col("similarity")).alias("c_vector"),
        F.when(F.col("entities") > 0, capped(w.per_entity, w.most_entities, F.col("entity_weight"))).alias("c_entity"),
        F.when(F.col("topics") > 0, capped(w.per_topic, w.most_topics, F.col("topic_weight"))).alias("c_topic"),
        F.when(F.col("citations") > 0, F.lit(w.cited)).alias("c_reference"),
        F.when(F.col("duplicate_similarity").isNotNull(), F.lit(w.copied)).alias("c_duplicate"),
    )
    kinds = ["c_vector", "c_entity", "c_topic", "c_reference", "c_duplicate"]
    total, fired = F.lit(0.0), F.lit(0)
    for kind in kinds:
        total = total + F.coalesce(kind, F.lit(0.0))
        fired = fired + F.col(kind).isNotNull().cast("int")
    return out.withColumns({"evidence_count": fired, "score": F.greatest(F.lit(w.lowest), F.least(F.lit(w.highest), total))})


def rank_key() -> list[Column]:
    """Score in quanta, then the number of signals, then the vector's part, then the path, which makes the order total."""
    return [F.desc(F.bround(F.col("score") / QUANTUM)), F.desc("evidence_count"), F.desc(F.coalesce("c_vector", F.lit(0.0))), F.asc("path")]


def why(evidence: Column) -> Column:
    """Details of ``array<struct<contribution, ordinal, detail>>``, the highest contribution first, joined."""
    order = F.array_sort(evidence, lambda a, b: F.when(a["contribution"] > b["contribution"], -1).when(a["contribution"] < b["contribution"], 1).when(a["ordinal"] < b["ordinal"], -1).when(a["ordinal"] > b["ordinal"], 1).otherwise(0))
    return F.array_join(F.transform(order, lambda e: e["detail"]), " + ")


def receipts(scored: DataFrame) -> DataFrame:
    """Adds ``evidence`` (kind, contribution, ordinal, detail) and the line ``why``; of connectors the first three by name are told."""
    detail = {
        "vector": F.format_string("vector similarity %.2f", "similarity"),
        "entity": F.format_string("shares %d entities: %s", "entities", F.array_join("entity_names", ", ")),
        "topic": F.format_string("shares %d topics: %s", "topics", F.array_join("topic_names", ", ")),
        "reference": F.lit("references top hit"),
        "duplicate": F.format_string("near-duplicate of top hit (%.2f)", "duplicate_similarity"),
    }
    items = [
        F.when(F.col(f"c_{kind}").isNotNull(), F.struct(F.lit(kind).alias("kind"), F.col(f"c_{kind}").alias("contribution"), F.lit(n).alias("ordinal"), text.alias("detail")))
        for n, (kind, text) in enumerate(detail.items())
    ]
    out = scored.withColumn("evidence", F.array_compact(F.array(*items)))
    return out.withColumn("why", why(F.col("evidence")))


def candidates(hits: DataFrame, files: DataFrame, edges: dict[str, DataFrame]) -> DataFrame:
    """Files found by vector or by an edge from those, with what was found; files without a record are dropped.

    ``hits`` are a bounded number of rows (the k of the search), so the frontier is broadcast. ``edges`` holds references,
    duplicates and connectors (or mentions and about), and the frontier's own connectors as ``mine`` if they are at hand.
    """
    best = vectors.best_per_file(hits)
    connected = edges["connectors"] if "connectors" in edges else graph.connectors(edges["mentions"], edges["about"])
    hops = graph.neighbours(F.broadcast(best), edges["references"], connected, edges["duplicates"], mine=edges.get("mine"))
    found = connector_evidence(hops).withColumnRenamed("peer", "file_id")
    both = found.join(best, "file_id", "full_outer")
    return both.join(files.select("file_id", "path", "summary"), "file_id").where(F.col("path").isNotNull())


def search(query: list[float] | None, chunks: DataFrame, files: DataFrame, edges: dict[str, DataFrame], top_chunks: int = 16, top_files: int = 8, weights: Weights = Weights()) -> DataFrame:
    """The best files for a query vector: ``file_id, path, summary, score, evidence_count`` and the contributions.

    No query gives no rows.
    """
    return ranked(vectors.top_chunks(chunks, query or [0.0], top_chunks if query else 0), files, edges, top_files, weights)


def ranked(hits: DataFrame, files: DataFrame, edges: dict[str, DataFrame], top_files: int = 8, weights: Weights = Weights()) -> DataFrame:
    """:func:`search` from hits at hand."""
    return contributions(candidates(hits, files, edges), weights).orderBy(*rank_key()).limit(top_files)


def context(ranked: DataFrame, hits: DataFrame, texts: DataFrame, max_tokens: int, per_file: int = 200) -> DataFrame:
    """The nearest chunks of ranked files that fit the budget: ``position, file_id, chunk_id, cost, used``.

    ``per_file`` is spent on every ranked file beforehand; chunks are taken in order of rank until one does not fit,
    files without a chunk are passed over. A chunk costs one at least, so stopping at the first that does not fit is a
    filter on the running sum. ``ranked`` has a few rows (the k of the search), its windows need no partitioning.
    """
    whole = Window.partitionBy(F.lit(1))
    order = whole.orderBy(*rank_key())
    places = ranked.select("*", F.row_number().over(order).alias("position"), F.count("*").over(whole).alias("files"))
    near = vectors.first_chunk_per_file(hits)
    chunk = texts.select(F.col("id").alias("chunk_id"), "text").join(F.broadcast(near), "chunk_id").groupBy("file_id", "chunk_id").agg(F.max(chunk_cost(F.coalesce("text", F.lit("")))).alias("cost"))
    running = whole.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    taken = places.join(chunk, "file_id").withColumn("used", F.sum("cost").over(running) + per_file * F.col("files"))
    return taken.where(F.col("used") <= max_tokens).select("position", "file_id", "chunk_id", "cost", "used")


def sketch_lines(hops: DataFrame, ranked: DataFrame) -> DataFrame:
    """``file_id, edges, line``: per ranked file its edges to other ranked files, sorted and joined behind its name."""
    label = F.when(F.col("via") == "mentioned-entity", F.concat(F.lit("MENTIONS-> "), "name")).when(F.col("via") == "shared-topic", F.concat(F.lit("TOPIC-> "), "name"))
    label = label.when(F.col("via") == "references", F.concat(F.lit("REFERENCES-> "), base_name(F.col("peer_path")))).otherwise(F.concat(F.lit("DUPLICATE_OF-> "), base_name(F.col("peer_path"))))
    few = ranked.select("file_id", "path")
    inside = hops.join(F.broadcast(few), "file_id").join(F.broadcast(few.select(F.col("file_id").alias("peer"), F.col("path").alias("peer_path"))), "peer")
    # Only edges among the ranked files, a few, are collected per row.
    lines = inside.select("file_id", "path", label.alias("edge")).groupBy("file_id", "path").agg(F.count("*").alias("edges"), F.array_join(F.sort_array(F.collect_list("edge")), "; ").alias("joined"))
    return lines.select("file_id", "edges", F.concat(base_name(F.col("path")), F.lit(" -- "), "joined").alias("line"))


def calibrated(signals: DataFrame, route: str = "route", score: str = "raw_score") -> DataFrame:
    """Adds ``calibrated``: the score between the least and the highest of its route; 1 where those are equal.

    The bounds come from one aggregate joined back, not from a window over the route.
    """
    bounds = signals.groupBy(F.col(route).alias("r")).agg(F.min(score).alias("low"), F.max(score).alias("high"))
    both = signals.join(bounds, F.col(route) == F.col("r"))
    return both.withColumn("calibrated", F.when(F.col("high") == F.col("low"), 1.0).otherwise((F.col(score) - F.col("low")) / (F.col("high") - F.col("low")))).drop("r", "low", "high")


def fused(signals: DataFrame) -> DataFrame:
    """``resource_id, score, signals``: the sum of calibrated scores of each resource over all routes."""
    return calibrated(signals).groupBy("resource_id").agg(F.sum("calibrated").alias("score"), F.count("*").alias("signals"))


def capped_hits(hits: DataFrame, per_resource: int, k: int) -> DataFrame:
    """The first k hits by score of which no resource has more than ``per_resource``; ties by id."""
    inside = Window.partitionBy("resource_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("place", F.row_number().over(inside)).where(F.col("place") <= per_resource).orderBy(F.desc("score"), "resource_id", "place").limit(k)


def fused_with_routes(signals: DataFrame) -> DataFrame:
    """``resource_id, score, routes``: :func:`fused`, with what each route added, by route; there are few routes."""
    each = calibrated(signals).groupBy("resource_id", "route").agg(F.sum("calibrated").alias("contribution"))
    return each.groupBy("resource_id").agg(F.sum("contribution").alias("score"), F.array_sort(F.collect_list(F.struct("route", "contribution"))).alias("routes"))
