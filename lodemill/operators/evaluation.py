"""Measures of retrieval and of recognised text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_and_rank(judgements: DataFrame, k: int) -> DataFrame:
    """Per modality the queries, mean recall among the first k returned and mean reciprocal rank.

    ``judgements(modality, returned, expected)`` with ``returned`` in order. Without expected items a query has no
    recall and is left out; a query that returns none of them has rank 0.
    """
    hits = F.size(F.array_intersect(F.slice("returned", 1, k), F.array_distinct("expected")))
    places = F.transform("returned", lambda r, i: F.when(F.array_contains("expected", r), i + 1))
    first = F.array_min(places)
    each = judgements.where(F.size("expected") > 0).select("modality", (hits / F.size(F.array_distinct("expected"))).alias("recall"), F.coalesce(1 / first, F.lit(0.0)).alias("rank"))
    return each.groupBy("modality").agg(F.count("*").alias("queries"), F.avg("recall").alias("recall"), F.avg("rank").alias("reciprocal_rank"))


def recall_by_counts(returned: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """``query, expected, recall, reciprocal_rank`` without lists, so that a query may expect any number of items.

    ``returned(query, id, place)`` with places from 1, ``expected(query, id)``. Recall counts the first k returned; the rank
    is that of the first expected item returned, 0 if none is. Queries that expect nothing are left out.
    """
    asked = expected.select("query", "id").distinct()
    both = asked.join(returned.groupBy("query", "id").agg(F.min("place").alias("place")), ["query", "id"], "left")
    g = both.groupBy("query").agg(F.count("*").alias("expected"), F.count_if(F.col("place") <= k).alias("hits"), F.min("place").alias("first"))
    return g.select("query", "expected", (F.col("hits") / F.col("expected")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def best_adapter(scores: DataFrame, least: bool = False) -> DataFrame:
    """Per metric the adapter with the highest mean over its cases' means, or the least (of times and sizes); ties by name."""
    sign = 1 if least else -1
    cases = scores.groupBy("metric", "adapter", "case").agg(F.avg("value").alias("v"))
    means = cases.groupBy("metric", "adapter").agg(F.avg("v").alias("mean"))
    return means.groupBy("metric").agg(F.min(F.struct((sign * F.col("mean")).alias("m"), "adapter")).alias("b")).select("metric", "b.adapter", (sign * F.col("b.m")).alias("mean"))


def box_overlap(a, b):
    """Intersection over union of two boxes (structs of left, top, right, bottom), as a column."""
    w = F.greatest(F.lit(0.0), F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"]))
    h = F.greatest(F.lit(0.0), F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"]))
    area = lambda x: (x["right"] - x["left"]) * (x["bottom"] - x["top"])
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))
