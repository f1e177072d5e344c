"""Joins beyond equality: as of a time, first matching pattern, dependencies against a state; and waves of a graph of stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodemill.functions.text import glob_regex


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, bucket: int) -> DataFrame:
    """``key, at, value`` of each left row: the value of the last right row of its key at or before it, null if none.

    Both sides lie in one sorted line per key and bucket of ``bucket`` units of ``at`` (numeric); each bucket starts
    with the last value before it, so that a busy key spreads over many tasks. Right rows at equal times: the highest value.
    """
    rows = left.select(F.col(key).alias("k"), F.col(at).alias("t"), F.lit(None).cast(right.schema[value].dataType).alias("v"), F.lit(1).alias("side")).unionByName(right.select(F.col(key).alias("k"), F.col(at).alias("t"), F.col(value).alias("v"), F.lit(0).alias("side")))
    rows = rows.withColumn("b", F.floor(F.col("t") / bucket))
    seen = F.when(F.col("side") == 0, F.struct("t", "v"))
    ends = rows.groupBy("k", "b").agg(F.max(seen).alias("last"))
    before = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("k", "b", F.max("last").over(before).alias("last")).where(F.col("last").isNotNull())
    line = rows.select("k", "b", "t", "side", seen.alias("s")).unionByName(carried.select("k", "b", F.lit(None).cast(rows.schema["t"].dataType).alias("t"), F.lit(-1).alias("side"), F.col("last").alias("s")))
    order = Window.partitionBy("k", "b").orderBy(F.asc_nulls_first("t"), "side").rowsBetween(Window.unboundedPreceding, 0)
    found = line.withColumn("best", F.max("s").over(order)).where(F.col("side") == 1)
    return found.select(F.col("k").alias(key), F.col("t").alias(at), F.col("best.v").alias(value))


def resolve_by_pattern(requests: DataFrame, registry: list[tuple[str, str, str]]) -> DataFrame:
    """``mime, kind, pipeline``: for each distinct request the first registered pipeline of its kind whose glob fits the mime.

    The registry, ``(name, mime glob, kind)`` in order, is part of the query text, so no join is planned.
    """
    asked = requests.select("mime", "kind").distinct()
    pick = F.lit(None).cast("string")
    for name, pattern, kind in reversed(registry):
        pick = F.when((F.col("kind") == kind) & F.col("mime").rlike(glob_regex(pattern)), F.lit(name)).otherwise(pick)
    return asked.select("mime", "kind", pick.alias("pipeline")).where(F.col("pipeline").isNotNull())


def dependency_status(dependencies: DataFrame, state: DataFrame) -> DataFrame:
    """``id, expected, actual, finding``: what became of each dependency: ok, missing, mismatch or unexpected.

    ``dependencies(id, expected)``: a null expectation wants the id absent. ``state(id, actual)`` has an id once.
    """
    there = state.select(F.col("id").alias("_id"), "actual")
    both = dependencies.select("id", "expected").join(there, F.col("id") == F.col("_id"), "left")
    finding = F.when(F.col("expected").isNull(), F.when(F.col("_id").isNull(), "ok").otherwise("unexpected")).when(F.col("_id").isNull(), "missing").when(F.col("expected").eqNullSafe(F.col("actual")), "ok").otherwise("mismatch")
    return both.select("id", "expected", "actual", finding.alias("finding"))


def waves(stages: dict[str, set[str]]) -> list[list[str]]:
    """Stages by rounds in which their inputs are done; a cycle or an unknown input is an error. For plans of a few stages."""
    unknown = {i for inputs in stages.values() for i in inputs} - stages.keys()
    if unknown:
        raise ValueError(f"unknown inputs: {sorted(unknown)}")
    done: set[str] = set()
    out = []
    while len(done) < len(stages):
        ready = sorted(s for s, inputs in stages.items() if s not in done and inputs <= done)
        if not ready:
            raise ValueError(f"stages wait for each other: {sorted(stages.keys() - done)}")
        out.append(ready)
        done.update(ready)
    return out


def downstream(stages: dict[str, set[str]], start: str) -> set[str]:
    """All stages that need ``start``, directly or through others."""
    found: set[str] = set()
    grown = {start}
    while grown:
        grown = {s for s, inputs in stages.items() if inputs & grown and s not in found}
        found |= grown
    return found
