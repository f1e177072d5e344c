"""Joins and fills over half-open time intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.least(a_end, b_end) - F.greatest(a_start, b_start)


def overlap_join(left: DataFrame, right: DataFrame, key: str, bucket: int) -> DataFrame:
    """Pairs of one key whose intervals overlap: columns ``l`` and ``r`` (structs) and ``overlap``.

    Both sides need ``key, start_ms, end_ms``. Intervals are cut into buckets of ``bucket`` and joined on key and
    bucket; a pair counts in the first bucket that both reach, so it comes once and no nested loop is planned. Empty
    intervals overlap nothing.
    """

    def cut(df: DataFrame, name: str, at: str) -> DataFrame:
        some = df.where(F.col("end_ms") > F.col("start_ms"))
        buckets = F.sequence(F.floor(F.col("start_ms") / bucket), F.floor((F.col("end_ms") - 1) / bucket))
        return some.select(F.col(key).alias(f"k_{name}"), F.struct(*df.columns).alias(name), F.explode(buckets).alias(at))

    a, b = cut(left, "l", "at_l"), cut(right, "r", "at_r")
    both = a.join(b, (F.col("k_l") == F.col("k_r")) & (F.col("at_l") == F.col("at_r")))
    shared = overlap(F.col("l.start_ms"), F.col("l.end_ms"), F.col("r.start_ms"), F.col("r.end_ms"))
    once = F.col("at_l") == F.floor(F.greatest("l.start_ms", "r.start_ms") / bucket)
    return both.where(once & (shared > 0)).select("l", "r", shared.alias("overlap"))


def label_by_overlap(segments: DataFrame, speakers: DataFrame, key: str, bucket: int = 10_000) -> DataFrame:
    """``key, start_ms, label``: for each segment the label of the interval that overlaps it most, null if none does.

    Of equal overlaps the one examined last that begins before the segment holds, else the first; ``ordinal`` is the
    order of examination. That rule is a fold over the few intervals at the top.
    """
    segments = segments.select(key, "start_ms", "end_ms")
    pairs = overlap_join(segments, speakers.select(key, "start_ms", "end_ms", "label", "ordinal"), key, bucket)
    best = Window.partitionBy(F.col(f"l.{key}"), F.col("l.start_ms"), F.col("l.end_ms"))
    top = pairs.withColumn("most", F.max("overlap").over(best)).where(F.col("overlap") == F.col("most"))
    early = F.col("r.start_ms") < F.col("l.start_ms")
    # The first at the maximum is taken; later equal ones replace it only if they begin before the segment.
    chosen = top.groupBy(F.col(f"l.{key}").alias("_key"), F.col("l.start_ms").alias("_start"), F.col("l.end_ms").alias("_end")).agg(
        F.coalesce(F.max_by(F.when(early, F.col("r.label")), F.when(early, F.col("r.ordinal"))), F.min_by("r.label", "r.ordinal")).alias("label")
    )
    return segments.join(chosen, (F.col(key) == F.col("_key")) & (F.col("start_ms") == F.col("_start")) & (F.col("end_ms") == F.col("_end")), "left").select(key, "start_ms", "end_ms", "label")


def texts_in(scenes: DataFrame, segments: DataFrame, key: str, bucket: int = 10_000) -> DataFrame:
    """``key, start_ms, segments, text``: per scene the texts of overlapping segments in their order, by lines; empty if none."""
    scenes = scenes.select(key, "start_ms", "end_ms")
    pairs = overlap_join(scenes, segments.select(key, "start_ms", "end_ms", "ord", "text"), key, bucket)
    # Segments of one scene only, so the list is bounded by what a scene holds.
    joined = pairs.groupBy(F.col(f"l.{key}").alias("_key"), F.col("l.start_ms").alias("_start")).agg(F.array_sort(F.collect_list(F.struct(F.col("r.ord").alias("o"), F.col("r.text").alias("t")))).alias("x"))
    found = joined.select("_key", "_start", F.size("x").alias("segments"), F.array_join(F.transform("x", lambda p: p["t"]), "\n").alias("text"))
    return scenes.join(found, (F.col(key) == F.col("_key")) & (F.col("start_ms") == F.col("_start")), "left").select(key, "start_ms", F.coalesce("segments", F.lit(0)).alias("segments"), F.coalesce("text", F.lit("")).alias("text"))


def filled_boundaries(boundaries: DataFrame, durations: DataFrame, key: str, most: int) -> DataFrame:
    """``key, boundary``: 0, the boundaries inside, the duration, and points so that no gap is wider than ``most``.

    ``boundaries(key, boundary)``, ``durations(key, duration)``; a duration of 0 or less has only the boundary 0.
    """
    inside = boundaries.join(durations, key).where((F.col("boundary") > 0) & (F.col("boundary") < F.col("duration"))).select(key, "boundary")
    ends = durations.select(key, F.explode(F.when(F.col("duration") > 0, F.array(F.lit(0), F.col("duration"))).otherwise(F.array(F.lit(0).cast("long")))).alias("boundary"))
    known = inside.unionByName(ends.select(key, F.col("boundary").cast("long").alias("boundary"))).distinct()
    before = F.lag("boundary").over(Window.partitionBy(key).orderBy("boundary"))
    steps = known.withColumn("before", before)
    new = F.when(F.col("boundary") - F.col("before") > most, F.filter(F.sequence(F.col("before") + most, F.col("boundary"), F.lit(most).cast("long")), lambda p: p < F.col("boundary"))).otherwise(F.array().cast("array<bigint>"))
    return steps.select(key, F.explode(F.concat(F.array("boundary"), new)).alias("boundary"))


def scenes(boundaries: DataFrame, key: str) -> DataFrame:
    """``key, start_ms, end_ms, keyframe_ms``: consecutive boundaries as scenes with a keyframe in the middle."""
    after = F.lead("boundary").over(Window.partitionBy(key).orderBy("boundary"))
    rows = boundaries.withColumn("end_ms", after).where(F.col("end_ms").isNotNull())
    return rows.select(key, F.col("boundary").alias("start_ms"), "end_ms", F.floor((F.col("boundary") + F.col("end_ms")) / 2).alias("keyframe_ms"))


def spread(rows: DataFrame, key: str, order: str, planned: int) -> DataFrame:
    """At most about ``planned`` rows of each key, spread evenly over their order instead of the first ones."""
    w = Window.partitionBy(key)
    numbered = rows.withColumn("i", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(planned - 1)), lambda k: F.least(F.col("n") - 1, F.bround(k * (F.col("n") / planned)).cast("long")))
    return numbered.where((F.col("n") <= planned) | F.array_contains(wanted, F.col("i").cast("long"))).drop("i", "n")
