"""Edges between files: expansion of a frontier and resolution of references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodemill.functions.text import base_name

_HOP = ["file_id", "peer", "via", "name", "weight"]

# In this order the first edge to a peer is told.
VIA_ORDER = ("references", "mentioned-entity", "shared-topic", "duplicate")


def connectors(mentions: DataFrame, about: DataFrame) -> DataFrame:
    """``file_id, via, name, weight`` of edges to entities and topics."""
    of = lambda rows, column, via: rows.select("file_id", F.lit(via).alias("via"), F.col(column).alias("name"), "weight")
    return of(mentions, "entity", "mentioned-entity").unionByName(of(about, "topic", "shared-topic"))


def neighbours(frontier: DataFrame, references: DataFrame, connected: DataFrame, duplicates: DataFrame, least_weight: float | None = None, mine: DataFrame | None = None) -> DataFrame:
    """``file_id, peer, via, name, weight``: all edges of one hop from the frontier's files, repeated ones kept.

    ``frontier(file_id)`` has each file once; ``connected`` is as :func:`connectors` gives it. Files that share a connector
    are peers; the frontier is joined before the edges meet themselves, so only its connectors expand, and ``mine`` spares
    that join where they are at hand. References and duplicates have no weight gate.
    """
    cited = references.join(frontier.select(F.col("file_id").alias("src")), "src").where(F.col("src") != F.col("dst")).select(F.col("src").alias("file_id"), F.col("dst").alias("peer"), F.lit("references").alias("via"), F.lit(None).cast("string").alias("name"), F.lit(1.0).alias("weight"))
    copies = duplicates.join(frontier.select(F.col("file_id").alias("src")), "src").where(F.col("src") != F.col("dst")).select(F.col("src").alias("file_id"), F.col("dst").alias("peer"), F.lit("duplicate").alias("via"), F.lit(None).cast("string").alias("name"), F.col("similarity").alias("weight"))
    mine = (connected.join(frontier.select("file_id"), "file_id") if mine is None else mine).select("file_id", "via", "name", F.col("weight").alias("w"))
    both = mine.join(connected.select(F.col("file_id").alias("peer"), "via", "name", F.col("weight").alias("v")), ["via", "name"]).where(F.col("peer") != F.col("file_id"))
    shared = both.select("file_id", "peer", "via", "name", F.least("w", "v").alias("weight"))
    if least_weight is not None:
        shared = shared.where(F.col("weight") >= least_weight)
    return cited.select(*_HOP).unionByName(shared.select(*_HOP)).unionByName(copies.select(*_HOP))


def related(hops: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """The first edge to each peer, by the order of kinds, then weight, name and file."""
    rank = F.array_position(F.array(*[F.lit(v) for v in VIA_ORDER]), F.col("via"))
    hops = hops if kinds is None else hops.where(F.col("via").isin(*kinds))
    order = Window.partitionBy("peer").orderBy(rank, F.desc("weight"), F.asc_nulls_first("name"), "file_id")
    return hops.withColumn("n", F.row_number().over(order)).where(F.col("n") == 1).drop("n")


def path_suffixes(files: DataFrame) -> DataFrame:
    """``suffix, file_id``: every tail of a path that begins behind a slash, and the path itself."""
    parts = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return files.where(F.col("path").isNotNull()).select("file_id", F.explode(F.array_distinct(tails)).alias("suffix")).where(F.col("suffix") != "")


def resolve_references(intents: DataFrame, files: DataFrame) -> DataFrame:
    """``source_id, reference, file_id``: what each reference means, if that is one file.

    A reference means the only file whose path is it or ends with a slash and it; failing that, the only file whose base
    name is its base name. The search for tails is an equi-join on the tails of all paths.
    """
    asked = intents.where(F.col("reference").isNotNull() & (F.trim("reference") != "")).select("source_id", F.trim("reference").alias("reference")).distinct()
    # A base name is a tail without a slash, so one pass over the tails of all paths answers both questions.
    keys = asked.select("reference").distinct().select("reference", F.explode(F.array(F.struct(F.lit(0).alias("named"), F.col("reference").alias("suffix")), F.struct(F.lit(1).alias("named"), base_name(F.col("reference")).alias("suffix")))).alias("k")).select("reference", "k.*")
    # Keys are distinct, so a file cited by all cannot make a busy key here.
    tails = path_suffixes(files).join(keys.select("suffix").distinct(), "suffix").groupBy("suffix").agg(F.count("*").alias("n"), F.min("file_id").alias("hit"))
    only = lambda named: F.max(F.when((F.col("named") == named) & (F.col("n") == 1), F.col("hit")))
    found = keys.join(tails, "suffix").groupBy("reference").agg(F.coalesce(only(0), only(1)).alias("file_id")).where(F.col("file_id").isNotNull())
    return asked.join(found, "reference").select("source_id", "reference", "file_id")


def reference_edges(resolved: DataFrame) -> DataFrame:
    """``src, dst`` once each, without those from a file to itself."""
    return resolved.where(F.col("source_id") != F.col("file_id")).select(F.col("source_id").alias("src"), F.col("file_id").alias("dst")).distinct()


def merge_edges(edges: DataFrame) -> DataFrame:
    """Weighted edges once each; another weight is another edge."""
    return edges.dropDuplicates(["src", "dst", "weight"])
