"""The tables of an engine query from the tables at hand, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.functions.text import base_name, extension
from lodemill.operators.graph import reference_edges, resolve_references
from lodemill.operators.records import latest_files
from lodemill.session import table


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_files(table(spark, sf_dir, "files"), ["name", "summary"]).withColumnRenamed("id", "file_id")


def connectors(rows: DataFrame) -> DataFrame:
    """``file_id, via, name, weight`` of rows of :func:`files`, in one pass.

    The second and third folder of a path are entities of a file, weighted by its size; its extension and year are topics.
    """
    weight = F.least(F.lit(1.0), F.coalesce(F.col("size_bytes"), F.lit(0)) / 4_000_000)
    topics = F.array_distinct(F.array(extension(F.col("path")), F.coalesce(F.year("last_indexed_at").cast("string"), F.lit("never"))))
    of = lambda names, via, w: F.transform(names, lambda x: F.struct(F.lit(via).alias("via"), x.alias("name"), w.alias("weight")))
    entities = F.array_distinct(F.coalesce(F.slice(F.split("path", "/"), 3, 2), F.array().cast("array<string>")))
    return rows.select("file_id", F.explode(F.concat(of(entities, "mentioned-entity", weight), of(topics, "shared-topic", F.lit(1.0)))).alias("c")).select("file_id", "c.*")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connectors(files(spark, sf_dir)).where(F.col("via") == "mentioned-entity").select("file_id", F.col("name").alias("entity"), "weight")


def about(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connectors(files(spark, sf_dir)).where(F.col("via") == "shared-topic").select("file_id", F.col("name").alias("topic"), "weight")


def duplicates(spark: SparkSession, sf_dir: str, among: list[str] | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "duplicates").where((F.col("src") != F.col("dst")) & F.col("similarity").between(0.0, 1.0))
    rows = rows if among is None else rows.where(F.col("src").isin(*among))
    return rows.groupBy("src", "dst").agg(F.max("similarity").alias("similarity"))


def intents(spark: SparkSession, sf_dir: str, own: DataFrame | None = None, among: list[str] | None = None) -> DataFrame:
    """A file refers to the name of each of its duplicates, and to the tail of its own path behind the first folder.

    ``own``: the rows of the files that are asked about, ``among`` their ids.
    """
    f = files(spark, sf_dir)
    named = duplicates(spark, sf_dir, among).join(f.select(F.col("file_id").alias("dst"), F.col("name").alias("reference")), "dst").select(F.col("src").alias("source_id"), "reference")
    own = (f if own is None else own).select(F.col("file_id").alias("source_id"), F.array_join(F.slice(F.split("path", "/"), 3, 99), "/").alias("reference"))
    return named.unionByName(own)


def references(spark: SparkSession, sf_dir: str, own: DataFrame | None = None, among: list[str] | None = None) -> DataFrame:
    return reference_edges(resolve_references(intents(spark, sf_dir, own, among), files(spark, sf_dir)))


def edges(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"references": references(spark, sf_dir), "connectors": connectors(files(spark, sf_dir)), "duplicates": duplicates(spark, sf_dir)}


def edges_of(spark: SparkSession, sf_dir: str, among: list[str]) -> dict[str, DataFrame]:
    """The edges of a few files: their own rows are read first, so that only their references are resolved."""
    few = files(spark, sf_dir).where(F.col("file_id").isin(*among))
    own = spark.createDataFrame(few.collect(), few.schema)
    return {"references": references(spark, sf_dir, own, among), "connectors": connectors(files(spark, sf_dir)), "duplicates": duplicates(spark, sf_dir, among), "mine": connectors(own)}


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """Stands in for a model: the vector of the first chunk, by id, that has a usable one."""
    from lodemill.operators.vectors import usable

    row = table(spark, sf_dir, "chunks").where(usable(F.col("vector"), 64) & F.exists("vector", lambda x: x != 0)).agg(F.min_by("vector", "id")).first()
    return [float(x) for x in row[0]] if row[0] else []


LATEST_FILES = """latest_files AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_indexed_at DESC NULLS LAST, mtime DESC NULLS LAST,
    size_bytes DESC NULLS LAST, content_hash DESC NULLS LAST, path DESC NULLS LAST, status DESC NULLS LAST) AS rn FROM files WHERE id IS NOT NULL) WHERE rn = 1)"""
EDGES = f"""{LATEST_FILES},
mentions AS (SELECT DISTINCT id AS file_id, unnest(string_split(path, '/')[3:4]) AS entity, least(1.0::double, coalesce(size_bytes, 0)::double / 4000000) AS weight FROM latest_files),
about AS (SELECT DISTINCT id AS file_id, unnest([lower(regexp_extract(string_split(path, '/')[-1], '(\\.[^./]+)$', 1)), coalesce(year(last_indexed_at)::varchar, 'never')]) AS topic, 1.0::double AS weight FROM latest_files),
dups AS (SELECT src, dst, max(similarity) AS similarity FROM duplicates WHERE src <> dst AND similarity BETWEEN 0 AND 1 AND similarity::varchar <> 'nan' GROUP BY src, dst),
intents AS (
  SELECT DISTINCT source_id, trim(reference) AS reference FROM (
    SELECT src AS source_id, name AS reference FROM dups JOIN latest_files ON dst = id
    UNION ALL SELECT id, array_to_string(string_split(path, '/')[3:], '/') FROM latest_files)
  WHERE trim(reference) <> ''),
exact AS (SELECT reference, count(*) AS n, min(id) AS hit FROM (SELECT DISTINCT reference FROM intents) JOIN latest_files ON path = reference OR ends_with(path, '/' || reference) GROUP BY reference),
named AS (SELECT string_split(path, '/')[-1] AS name, count(*) AS n, min(id) AS hit FROM latest_files GROUP BY 1),
resolved AS (
  SELECT source_id, i.reference, CASE WHEN e.n = 1 THEN e.hit WHEN m.n = 1 THEN m.hit END AS file_id
  FROM intents i LEFT JOIN exact e USING (reference) LEFT JOIN named m ON m.name = string_split(i.reference, '/')[-1]),
refs AS (SELECT DISTINCT source_id AS src, file_id AS dst FROM resolved WHERE file_id IS NOT NULL AND source_id <> file_id)"""
USABLE = "len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
HITS = f"""q AS (SELECT arg_min(vector, id) AS v FROM chunks WHERE {USABLE} AND len(list_filter(vector, lambda x: x <> 0)) > 0),
dist AS (SELECT DISTINCT id AS chunk_id, file_id, list_sum(list_transform(list_zip(vector, q.v), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))) AS distance FROM chunks, q WHERE id IS NOT NULL AND {USABLE}),
hits AS (SELECT * FROM dist ORDER BY distance, chunk_id LIMIT 16),
frontier AS (SELECT file_id, max(1 / (1 + distance)) AS similarity FROM hits GROUP BY file_id),
hops AS (
  SELECT f.file_id, dst AS peer, 'references' AS via, NULL::varchar AS name, 1.0::double AS weight FROM frontier f JOIN refs ON src = f.file_id
  UNION ALL SELECT f.file_id, b.file_id, 'mentioned-entity', a.entity, least(a.weight, b.weight) FROM frontier f JOIN mentions a USING (file_id) JOIN mentions b ON a.entity = b.entity AND b.file_id <> f.file_id
  UNION ALL SELECT f.file_id, b.file_id, 'shared-topic', a.topic, least(a.weight, b.weight) FROM frontier f JOIN about a USING (file_id) JOIN about b ON a.topic = b.topic AND b.file_id <> f.file_id
  UNION ALL SELECT f.file_id, dst, 'duplicate', NULL, dups.similarity FROM frontier f JOIN dups ON src = f.file_id)"""
SCORED = """found AS (
  SELECT peer AS file_id, sum(weight) FILTER (via = 'mentioned-entity') AS entity_weight, count(*) FILTER (via = 'mentioned-entity') AS entities,
    sum(weight) FILTER (via = 'shared-topic') AS topic_weight, count(*) FILTER (via = 'shared-topic') AS topics,
    count(*) FILTER (via = 'references') AS citations, max(weight) FILTER (via = 'duplicate') AS duplicate_similarity
  FROM hops GROUP BY peer),
scored AS (
  SELECT file_id, l.path, l.summary, similarity, entities, topics, citations, duplicate_similarity,
    CASE WHEN similarity > 0 THEN 0.5 * similarity END AS c_vector,
    CASE WHEN entities > 0 THEN least(0.3, 0.12 * entity_weight) END AS c_entity,
    CASE WHEN topics > 0 THEN least(0.2, 0.08 * topic_weight) END AS c_topic,
    CASE WHEN citations > 0 THEN 0.25 END AS c_reference,
    CASE WHEN duplicate_similarity IS NOT NULL THEN -0.05 END AS c_duplicate
  FROM frontier FULL OUTER JOIN found USING (file_id) JOIN latest_files l ON l.id = file_id WHERE l.path IS NOT NULL),
ranked AS (
  SELECT *, (c_vector IS NOT NULL)::int + (c_entity IS NOT NULL)::int + (c_topic IS NOT NULL)::int + (c_reference IS NOT NULL)::int + (c_duplicate IS NOT NULL)::int AS evidence_count,
    greatest(0, least(1, coalesce(c_vector, 0)::double + coalesce(c_entity, 0)::double + coalesce(c_topic, 0)::double + coalesce(c_reference, 0)::double + coalesce(c_duplicate, 0)::double)) AS score
  FROM scored)"""
RANK = "round_even(score / 1e-6, 0) DESC, evidence_count DESC, coalesce(c_vector, 0) DESC, path"
