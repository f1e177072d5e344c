"""Exact vector search over arrays of floats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usable(vector: Column, dimension: int) -> Column:
    """Whether a vector has the dimension and only finite values."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(vector) == dimension) & finite


def squared_distance(vector: Column, query: Column) -> Column:
    """In double precision, summed in the order of the values."""
    gaps = F.zip_with(vector, query, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)


def similarity(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def top_chunks(chunks: DataFrame, query: list[float], k: int) -> DataFrame:
    """``chunk_id, file_id, distance``: the k chunks nearest to the query, equal distances by id.

    Vectors of another dimension or with values that are null or not finite take no part; repeated rows count once.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    near = chunks.where(F.col("id").isNotNull() & usable(F.col("vector"), len(query))).select(F.col("id").alias("chunk_id"), "file_id", squared_distance(F.col("vector"), q).alias("distance"))
    # A row repeated whole gives the same three values, so the distinct runs over narrow rows after the scan.
    return near.distinct().orderBy("distance", "chunk_id").limit(k)


def best_per_file(hits: DataFrame) -> DataFrame:
    """``file_id, similarity``: the best hit of each file."""
    return hits.groupBy("file_id").agg(F.max(similarity(F.col("distance"))).alias("similarity"))


def first_chunk_per_file(hits: DataFrame) -> DataFrame:
    """The nearest chunk of each file among the hits."""
    order = Window.partitionBy("file_id").orderBy("distance", "chunk_id")
    return hits.withColumn("n", F.row_number().over(order)).where(F.col("n") == 1).drop("n")


def mean_vectors(chunks: DataFrame, dimension: int) -> DataFrame:
    """``file_id, mean``: the mean of the usable vectors of each file's chunks, as an array; partial sums before the shuffle."""
    rows = chunks.where(F.col("file_id").isNotNull() & usable(F.col("vector"), dimension)).select("id", "file_id", *[F.col("vector")[i].cast("double").alias(f"v{i}") for i in range(dimension)])
    once = rows.groupBy("id", "file_id").agg(*[F.max(f"v{i}").alias(f"v{i}") for i in range(dimension)])
    means = once.groupBy("file_id").agg(*[F.avg(f"v{i}").alias(f"v{i}") for i in range(dimension)])
    return means.select("file_id", F.array(*[f"v{i}" for i in range(dimension)]).alias("mean"))
