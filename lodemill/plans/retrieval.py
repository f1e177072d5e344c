"""Search, context and relations of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.operators import graph, retrieval, vectors
from lodemill.plans import binding
from lodemill.plans.binding import EDGES, HITS, LATEST_FILES, RANK, SCORED, USABLE
from lodemill.session import table


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen hits, fetched once: every later step starts from these few rows."""
    found = vectors.top_chunks(table(spark, sf_dir, "chunks"), binding.query_vector(spark, sf_dir), 16)
    return spark.createDataFrame(found.collect(), found.schema)


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The hits, and the edges of their files."""
    hits = _hits(spark, sf_dir)
    return hits, binding.edges_of(spark, sf_dir, sorted({r.file_id for r in hits.collect() if r.file_id is not None}))


def _hops(spark: SparkSession, sf_dir: str, least_weight: float | None = None) -> DataFrame:
    hits, e = _found(spark, sf_dir)
    return graph.neighbours(F.broadcast(vectors.best_per_file(hits)), e["references"], e["connectors"], e["duplicates"], least_weight, e["mine"])


def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("chunk_id", "file_id", F.round("distance", 6).alias("distance"), F.round(vectors.similarity(F.col("distance")), 6).alias("similarity"))


def best_file_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.best_per_file(_hits(spark, sf_dir)).select("file_id", F.round("similarity", 6).alias("similarity"))


def first_chunk_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.first_chunk_per_file(_hits(spark, sf_dir)).select("file_id", "chunk_id")


def visual_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings by label: each label is a space of its own, searched only within it."""
    e = table(spark, sf_dir, "embeddings")
    query = e.where("vec_id = 0").select(F.col("embedding").alias("q"), F.col("label").alias("space"))
    near = e.join(F.broadcast(query), (F.col("label") == F.col("space")) & (F.size("embedding") == F.size("q")))
    return near.select("vec_id", F.col("label"), F.round(vectors.squared_distance(F.col("embedding"), F.col("q")), 6).alias("distance")).orderBy("distance", "vec_id").limit(20)


def file_mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = vectors.mean_vectors(table(spark, sf_dir, "chunks"), 64)
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x))
    return means.select("file_id", F.round(norm, 6).alias("norm"), F.round(F.col("mean")[0], 6).alias("first"))


def neighbour_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hops(spark, sf_dir).select("file_id", "peer", "via", "name", F.round("weight", 6).alias("weight"))


def gated_entity_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = _hops(spark, sf_dir, least_weight=0.35)
    return hops.groupBy("via").agg(F.count("*").alias("edges"), F.countDistinct("peer").alias("peers"))


def related_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = binding.files(spark, sf_dir).select(F.col("file_id").alias("peer"), "path")
    first = graph.related(_hops(spark, sf_dir), ["references", "mentioned-entity", "duplicate"])
    return first.join(paths, "peer").select("peer", "path", "via", "file_id", F.round("weight", 6).alias("weight"))


def resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolve_references(binding.intents(spark, sf_dir), binding.files(spark, sf_dir))


def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.references(spark, sf_dir)


def direct_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, a = binding.mentions(spark, sf_dir), binding.about(spark, sf_dir)
    entities = m.groupBy("file_id").agg(F.array_join(F.sort_array(F.collect_set("entity")), ",").alias("entities"))
    topics = a.groupBy("file_id").agg(F.array_join(F.sort_array(F.collect_set("topic")), ",").alias("topics"))
    return entities.join(topics, "file_id", "full_outer").select("file_id", "entities", "topics")


def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "duplicates").select("src", "dst", F.col("similarity").alias("weight"))
    return graph.merge_edges(edges).groupBy("src").agg(F.count("*").alias("edges"))


def node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, m, a = binding.files(spark, sf_dir), binding.mentions(spark, sf_dir), binding.about(spark, sf_dir)
    parts = [f.agg(F.count("*").alias("nodes")).withColumn("kind", F.lit("file")), m.agg(F.countDistinct("entity").alias("nodes")).withColumn("kind", F.lit("entity")), a.agg(F.countDistinct("topic").alias("nodes")).withColumn("kind", F.lit("topic"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def connector_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.connector_evidence(_hops(spark, sf_dir))
    return found.select("peer", F.round("entity_weight", 6).alias("entity_weight"), "entities", F.round("topic_weight", 6).alias("topic_weight"), "topics", "citations", F.round("duplicate_similarity", 6).alias("duplicate_similarity"))


def _search(spark: SparkSession, sf_dir: str, top: int = 8) -> DataFrame:
    hits, edges = _found(spark, sf_dir)
    return retrieval.ranked(hits, binding.files(spark, sf_dir), edges, top_files=top)


def search_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir).select("file_id", "path", F.round("score", 6).alias("score"), "evidence_count")


def search_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates with their contributions."""
    hits, edges = _found(spark, sf_dir)
    found = retrieval.candidates(hits, binding.files(spark, sf_dir), edges)
    scored = retrieval.contributions(found, retrieval.Weights())
    return scored.select("file_id", *[F.round(c, 6).alias(c) for c in ("c_vector", "c_entity", "c_topic", "c_reference", "c_duplicate", "score")], "evidence_count")


def search_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.receipts(_search(spark, sf_dir)).select("file_id", "why", F.size("evidence").alias("signals"))


def build_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, edges = _found(spark, sf_dir)
    ranked = retrieval.ranked(hits, binding.files(spark, sf_dir), edges)
    return retrieval.context(ranked, hits, table(spark, sf_dir, "chunks").where(F.col("id").isin(*[r.chunk_id for r in hits.collect()])), 2200)


def context_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _search(spark, sf_dir).select("file_id", "path")
    ranked = spark.createDataFrame(found.collect(), found.schema)  # the eight files of the search
    e = binding.edges_of(spark, sf_dir, [r.file_id for r in ranked.collect()])
    hops = graph.neighbours(F.broadcast(ranked.select("file_id")), e["references"], e["connectors"], e["duplicates"], mine=e["mine"])
    return retrieval.sketch_lines(hops, ranked)


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Representations with a confidence: each kind is a route, the version is the resource."""
    r = table(spark, sf_dir, "representations").where(F.col("confidence").isNotNull() & F.col("status").isin("current", "partial"))
    return r.select("id", F.col("resource_version_id").alias("resource_id"), F.col("kind").alias("route"), F.col("confidence").alias("raw_score")).distinct()


def calibrated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.calibrated(_signals(spark, sf_dir)).select("id", "resource_id", "route", F.round("calibrated", 6).alias("calibrated"))


def fused_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fused(_signals(spark, sf_dir)).select("resource_id", F.round("score", 6).alias("score"), "signals")


def media_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _signals(spark, sf_dir).select("id", F.col("route").alias("resource_id"), F.col("raw_score").alias("score"))
    return retrieval.capped_hits(hits, 3, 12).select("id", "resource_id", "score")


QUERIES = {f.__name__: f for f in (vector_top_k, best_file_similarity, first_chunk_per_file, visual_top_k, file_mean_vector, neighbour_edges, gated_entity_peers, related_files, resolved_references, reference_edges, direct_relationships, merged_edges, node_counts, connector_evidence, search_files, search_candidates, search_receipts, build_context, context_sketch, calibrated_scores, fused_media, media_hits)}

_BASE = f"WITH {EDGES}, {HITS}, {SCORED}"
_SIGNALS = "signals AS (SELECT DISTINCT id, resource_version_id AS resource_id, kind AS route, confidence AS raw_score FROM representations WHERE confidence IS NOT NULL AND status IN ('current', 'partial')), cal AS (SELECT *, CASE WHEN max(raw_score) OVER w = min(raw_score) OVER w THEN 1.0 ELSE (raw_score - min(raw_score) OVER w) / (max(raw_score) OVER w - min(raw_score) OVER w) END AS calibrated FROM signals WINDOW w AS (PARTITION BY route))"
SQL = {
    "vector_top_k": f"{_BASE} SELECT chunk_id, file_id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity FROM hits",
    "best_file_similarity": f"{_BASE} SELECT file_id, round(similarity, 6) AS similarity FROM frontier",
    "first_chunk_per_file": f"{_BASE} SELECT file_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY distance, chunk_id) AS n FROM hits) WHERE n = 1",
    "visual_top_k": """SELECT vec_id, e.label, round(list_sum(list_transform(list_zip(embedding, q), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))), 6) AS distance
FROM embeddings e JOIN (SELECT embedding AS q, label FROM embeddings WHERE vec_id = 0) x ON e.label = x.label AND len(embedding) = len(q) ORDER BY distance, vec_id LIMIT 20""",
    "file_mean_vector": f"""WITH v AS (SELECT DISTINCT id, file_id, vector FROM chunks WHERE file_id IS NOT NULL AND {USABLE}),
u AS (SELECT file_id, i, avg(vector[i]::double) AS m FROM v, range(1, 65) t(i) GROUP BY file_id, i)
SELECT file_id, round(sqrt(sum(m * m)), 6) AS norm, round(max(m) FILTER (i = 1), 6) AS first FROM u GROUP BY file_id""",
    "neighbour_edges": f"{_BASE} SELECT file_id, peer, via, name, round(weight, 6) AS weight FROM hops",
    "gated_entity_peers": f"{_BASE} SELECT via, count(*) AS edges, count(DISTINCT peer) AS peers FROM hops WHERE via IN ('references', 'duplicate') OR weight >= 0.35 GROUP BY via",
    "related_files": f"""{_BASE} SELECT peer, l.path, via, file_id, round(weight, 6) AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY peer ORDER BY list_position(['references', 'mentioned-entity', 'shared-topic', 'duplicate'], via), weight DESC, name NULLS FIRST, file_id) AS n
  FROM hops WHERE via <> 'shared-topic') JOIN latest_files l ON l.id = peer WHERE n = 1""",
    "resolved_references": f"WITH {EDGES} SELECT source_id, reference, file_id FROM resolved WHERE file_id IS NOT NULL",
    "reference_edges": f"WITH {EDGES} SELECT src, dst FROM refs",
    "direct_relationships": f"WITH {EDGES}, e AS (SELECT file_id, string_agg(DISTINCT entity, ',' ORDER BY entity) AS entities FROM mentions GROUP BY 1), t AS (SELECT file_id, string_agg(DISTINCT topic, ',' ORDER BY topic) AS topics FROM about GROUP BY 1) SELECT file_id, entities, topics FROM e FULL OUTER JOIN t USING (file_id)",
    "merged_edges": "SELECT src, count(*) AS edges FROM (SELECT DISTINCT src, dst, similarity FROM duplicates) GROUP BY src",
    "node_counts": f"WITH {EDGES} SELECT 'file' AS kind, count(*) AS nodes FROM latest_files UNION ALL SELECT 'entity', count(DISTINCT entity) FROM mentions UNION ALL SELECT 'topic', count(DISTINCT topic) FROM about",
    "connector_evidence": f"{_BASE} SELECT file_id AS peer, round(entity_weight, 6) AS entity_weight, entities, round(topic_weight, 6) AS topic_weight, topics, citations, round(duplicate_similarity, 6) AS duplicate_similarity FROM found",
    "search_files": f"{_BASE} SELECT file_id, path, round(score, 6) AS score, evidence_count FROM ranked ORDER BY {RANK} LIMIT 8",
    "search_candidates": f"{_BASE} SELECT file_id, round(c_vector, 6) AS c_vector, round(c_entity, 6) AS c_entity, round(c_topic, 6) AS c_topic, c_reference::double AS c_reference, c_duplicate::double AS c_duplicate, round(score, 6) AS score, evidence_count FROM ranked",
    "search_receipts": f"""{_BASE}, top AS (SELECT * FROM ranked ORDER BY {RANK} LIMIT 8),
names AS (SELECT peer AS file_id, via, list_sort(list(DISTINCT name))[1:3] AS three FROM hops WHERE name IS NOT NULL GROUP BY 1, 2),
e AS (SELECT file_id, c_vector AS c, 0 AS o, printf('vector similarity %.2f', similarity) AS detail FROM top WHERE c_vector IS NOT NULL
  UNION ALL SELECT file_id, c_entity, 1, 'shares ' || entities || ' entities: ' || array_to_string(three, ', ') FROM top JOIN names USING (file_id) WHERE c_entity IS NOT NULL AND via = 'mentioned-entity'
  UNION ALL SELECT file_id, c_topic, 2, 'shares ' || topics || ' topics: ' || array_to_string(three, ', ') FROM top JOIN names USING (file_id) WHERE c_topic IS NOT NULL AND via = 'shared-topic'
  UNION ALL SELECT file_id, c_reference, 3, 'references top hit' FROM top WHERE c_reference IS NOT NULL
  UNION ALL SELECT file_id, c_duplicate, 4, printf('near-duplicate of top hit (%.2f)', duplicate_similarity) FROM top WHERE c_duplicate IS NOT NULL)
SELECT file_id, string_agg(detail, ' + ' ORDER BY c DESC, o) AS why, count(*)::int AS signals FROM e GROUP BY 1""",
    "context_sketch": f"""{_BASE}, top AS (SELECT file_id, path FROM ranked ORDER BY {RANK} LIMIT 8),
h AS (SELECT src AS file_id, dst AS peer, 'REFERENCES-> ' AS via, NULL::varchar AS name FROM refs
  UNION ALL SELECT a.file_id, b.file_id, 'MENTIONS-> ', a.entity FROM mentions a JOIN mentions b ON a.entity = b.entity AND b.file_id <> a.file_id
  UNION ALL SELECT a.file_id, b.file_id, 'TOPIC-> ', a.topic FROM about a JOIN about b ON a.topic = b.topic AND b.file_id <> a.file_id
  UNION ALL SELECT src, dst, 'DUPLICATE_OF-> ', NULL FROM dups),
l AS (SELECT t.file_id, t.path, via || coalesce(name, string_split(p.path, '/')[-1]) AS edge FROM h JOIN top t USING (file_id) JOIN top p ON p.file_id = h.peer)
SELECT file_id, count(*) AS edges, string_split(any_value(path), '/')[-1] || ' -- ' || string_agg(edge, '; ' ORDER BY edge) AS line FROM l GROUP BY 1""",
    "build_context": f"""{_BASE}, top AS (SELECT *, row_number() OVER (ORDER BY {RANK}) AS position FROM ranked QUALIFY position <= 8),
near AS (SELECT file_id, chunk_id FROM hits QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY distance, chunk_id) = 1),
cost AS (SELECT file_id, chunk_id, max(greatest(1, length(coalesce(text, '')) // 4)) AS cost FROM near JOIN chunks USING (file_id) WHERE id = chunk_id GROUP BY 1, 2)
SELECT * FROM (SELECT position, file_id, chunk_id, cost, sum(cost) OVER (ORDER BY position) + 200 * (SELECT count(*) FROM top) AS used FROM top JOIN cost USING (file_id)) WHERE used <= 2200""",
    "calibrated_scores": f"WITH {_SIGNALS} SELECT id, resource_id, route, round(calibrated, 6) AS calibrated FROM cal",
    "fused_media": f"WITH {_SIGNALS} SELECT resource_id, round(sum(calibrated), 6) AS score, count(*) AS signals FROM cal GROUP BY resource_id",
    "media_hits": f"WITH {_SIGNALS} SELECT id, route AS resource_id, raw_score AS score FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY raw_score DESC, id) AS n FROM signals) WHERE n <= 3 ORDER BY raw_score DESC, route, n LIMIT 12",
}
