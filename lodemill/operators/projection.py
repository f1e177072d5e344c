"""Searchable projections: text of media with vectors, the graph of media, and the graph of files, applied and rebuilt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.operators.records import replace_by_key
from lodemill.operators.representations import TEXT_KINDS, VISIBLE
from lodemill.operators.vectors import similarity, squared_distance, usable


def media_text_rows(representations: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """Rows of the index of media text: representations of a text kind that are shown, have a text and a usable vector.

    ``representations(id, resource_version_id, kind, status, textual_payload, locators, coverage_fraction)`` once per id,
    ``vectors(id, vector)``. Other kinds and statuses, and rows without a vector, are left out.
    """
    shown = representations.where(F.col("kind").isin(*TEXT_KINDS) & F.col("status").isin(*VISIBLE) & F.col("textual_payload").isNotNull())
    rows = shown.join(vectors.where(usable(F.col("vector"), dimension)).select("id", "vector"), "id")
    return rows.select(F.col("id").alias("representation_id"), "resource_version_id", "kind", "status", F.col("textual_payload").alias("text"), "locators", "coverage_fraction", "vector")


def upserted(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The index with the rows of each representation replaced."""
    return replace_by_key(index, rows, "representation_id")


def media_text_top_k(index: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k nearest rows with what a citation needs: ids, kind, locators, coverage, and the score."""
    distance = squared_distance(F.col("vector"), F.array(*[F.lit(float(x)) for x in query]))
    near = index.select("representation_id", "resource_version_id", "kind", "locators", "coverage_fraction", "text", distance.alias("distance"))
    return near.orderBy("distance", "representation_id").limit(k).withColumn("score", similarity(F.col("distance")))


def media_graph(representations: DataFrame) -> DataFrame:
    """``src, edge, dst``: shown representations hang on their version, and their locators on them.

    ``representations(id, resource_version_id, kind, status, locators array<struct<kind, key>>)``.
    """
    shown = representations.where(F.col("status").isin(*VISIBLE))
    has = shown.select(F.col("resource_version_id").alias("src"), F.lit("HAS_REPRESENTATION").alias("edge"), F.col("id").alias("dst"))
    at = shown.select("id", F.explode("locators").alias("l")).select(F.col("id").alias("src"), F.concat(F.lit("LOCATED_"), F.upper("l.kind")).alias("edge"), F.col("l.key").alias("dst"))
    return has.unionByName(at).where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()


def without_versions(graph: DataFrame, gone: DataFrame) -> DataFrame:
    """The media graph without versions, their representations and what hangs on those."""
    versions = gone.select(F.col("resource_version_id").alias("src")).distinct()
    lost = graph.where(F.col("edge") == "HAS_REPRESENTATION").join(versions, "src").select(F.col("dst").alias("src"))
    return graph.join(versions.unionByName(lost).distinct(), "src", "left_anti")


def intent_rows(references: DataFrame) -> DataFrame:
    """``id, source_id, reference``: the trimmed, distinct references of each source that are not empty, under a hash of both."""
    rows = references.select("source_id", F.trim("reference").alias("reference")).where(F.col("source_id").isNotNull() & (F.coalesce(F.col("reference"), F.lit("")) != "")).distinct()
    return rows.select(F.sha2(F.concat("source_id", F.lit("\\0"), "reference"), 256).alias("id"), "source_id", "reference")


def extraction_applied(edges: DataFrame, extractions: DataFrame) -> DataFrame:
    """``file_id, kind, name, weight``: the edges of files after new extractions.

    ``extractions(file_id, entities, topics array<struct<name, weight>>, references array<string>)``: all edges of each file
    that was extracted again give way to those of its extraction; of repeated names the largest weight holds.
    """
    of = lambda kind, column: extractions.select("file_id", F.explode(column).alias("x")).select("file_id", F.lit(kind).alias("kind"), F.trim("x.name").alias("name"), F.col("x.weight").alias("weight"))
    cited = extractions.select("file_id", F.explode("references").alias("name")).select("file_id", F.lit("intent").alias("kind"), F.trim("name").alias("name"), F.lit(1.0).alias("weight"))
    new = of("entity", "entities").unionByName(of("topic", "topics")).unionByName(cited).where(F.coalesce(F.col("name"), F.lit("")) != "")
    new = new.groupBy("file_id", "kind", "name").agg(F.max("weight").alias("weight"))
    old = edges.join(extractions.select("file_id").distinct(), "file_id", "left_anti")
    return old.select("file_id", "kind", "name", "weight").unionByName(new)


def rebuilt(files: DataFrame, entities: DataFrame, topics: DataFrame, references: DataFrame, duplicates: DataFrame) -> DataFrame:
    """``kind, a, b, weight``: nodes (``b`` null) and edges of the whole graph from the tables that hold.

    Edges need their files on record; entities and topics enter with weight 1; repeated edges are one, of duplicates the
    most similar. A second run gives the same graph.
    """
    known = files.select("file_id").where(F.col("file_id").isNotNull()).distinct()
    node = lambda kind, rows, column: rows.select(F.lit(kind).alias("kind"), F.col(column).alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("double").alias("weight"))
    mine = lambda rows: rows.join(known, "file_id", "left_semi")
    both = lambda rows: rows.join(known.withColumnRenamed("file_id", "src"), "src", "left_semi").join(known.withColumnRenamed("file_id", "dst"), "dst", "left_semi")
    e, t = mine(entities.select("file_id", "entity").distinct()), mine(topics.select("file_id", "topic").distinct())
    parts = [
        node("file", known, "file_id"), node("entity", e.select("entity").distinct(), "entity"), node("topic", t.select("topic").distinct(), "topic"),
        e.select(F.lit("MENTIONS").alias("kind"), F.col("file_id").alias("a"), F.col("entity").alias("b"), F.lit(1.0).alias("weight")),
        t.select(F.lit("ABOUT").alias("kind"), F.col("file_id").alias("a"), F.col("topic").alias("b"), F.lit(1.0).alias("weight")),
        both(references.select("src", "dst").distinct()).select(F.lit("REFERENCES").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("weight")),
        both(duplicates.groupBy("src", "dst").agg(F.max("similarity").alias("weight"))).select(F.lit("DUPLICATE_OF").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "weight"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
