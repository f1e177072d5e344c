"""Event logs: sequences, gaps, deliveries, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def next_sequence(events: DataFrame) -> DataFrame:
    """``workspace_id, last_sequence, next_sequence`` of each workspace."""
    last = F.coalesce(F.max("sequence"), F.lit(0))
    return events.groupBy("workspace_id").agg(last.alias("last_sequence"), (last + 1).alias("next_sequence"))


def recent(events: DataFrame, limit: int) -> DataFrame:
    """The newest events of each workspace, ``limit`` at most; the window limit prunes before the shuffle."""
    order = Window.partitionBy("workspace_id").orderBy(F.desc("sequence"), "id")
    return events.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def page(events: DataFrame, workspace_id: str, after: int, limit: int) -> DataFrame:
    """The next events of a workspace behind a cursor."""
    return events.where((F.col("workspace_id") == workspace_id) & (F.col("sequence") > after)).orderBy("sequence", "id").limit(limit)


def gaps(events: DataFrame, key: str = "workspace_id", sequence: str = "sequence", block_bits: int = 14) -> DataFrame:
    """``key, previous, current``: where a sequence does not go on by one. The first is no gap, null numbers are passed over.

    Numbers are compared within blocks of ``2**block_bits``; each block's first is compared with the last of the block
    before, so that one busy key spreads over many tasks. Repeated numbers count once.
    """
    rows = events.where(F.col(sequence).isNotNull()).groupBy(key, F.col(sequence).alias("n")).agg(F.lit(1)).select(key, "n", F.shiftright("n", block_bits).alias("block"))
    inside = rows.withColumn("before", F.lag("n").over(Window.partitionBy(key, "block").orderBy("n")))
    ends = rows.groupBy(key, "block").agg(F.min("n").alias("n"), F.max("n").alias("last"))
    across = ends.withColumn("before", F.lag("last").over(Window.partitionBy(key).orderBy("block"))).select(key, "n", "before")
    both = inside.where(F.col("before").isNotNull()).select(key, "n", "before").unionByName(across.where(F.col("before").isNotNull()))
    return both.where(F.col("n") != F.col("before") + 1).select(key, F.col("before").alias("previous"), F.col("n").alias("current"))


def freshness(outbox: DataFrame, offsets: DataFrame) -> DataFrame:
    """Per projection and workspace what is applied, the latest, and how many rows lag; keys of either side count.

    The lag is counted by one pass over the rows, joined with the offsets of their key, and partial sums.
    """
    keys = ["projection", "workspace_id"]
    marks = offsets.groupBy(*keys).agg(F.max("applied").alias("applied"))
    rows = outbox.join(marks, keys, "left").groupBy(*keys).agg(F.max("id").alias("latest"), F.count_if(F.col("id") > F.coalesce("applied", F.lit(0))).alias("lag"))
    both = rows.join(marks, keys, "full_outer")
    return both.select(*keys, F.coalesce("applied", F.lit(0)).alias("applied"), F.coalesce("latest", F.lit(0)).alias("latest"), F.coalesce("lag", F.lit(0)).alias("lag"), (F.coalesce("lag", F.lit(0)) > 0).alias("lagging"))


def delivery_batch(outbox: DataFrame, offsets: DataFrame, size: int) -> DataFrame:
    """The next ``size`` rows to deliver for each projection and workspace, in order of id."""
    keys = ["projection", "workspace_id"]
    waiting = outbox.join(offsets.groupBy(*keys).agg(F.max("applied").alias("applied")), keys, "left").where(F.col("id") > F.coalesce("applied", F.lit(0)))
    return waiting.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("place") <= size).select(*keys, "id", "place")


def latest_per_key(rows: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """The row of each key that is last by ``order``; an aggregate, so that it folds before the shuffle."""
    best = rows.groupBy(key).agg(F.max(F.struct(*order, *keep)).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in dict.fromkeys([*order, *keep])])


def metric_summary(events: DataFrame, name: str, value: str, at: str, tie: str) -> DataFrame:
    """Count, total, least, highest, last and mean of each metric."""
    return events.groupBy(F.col(name).alias("name")).agg(
        F.count(value).alias("count"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total"), F.min(value).alias("least"), F.max(value).alias("highest"),
        F.max_by(value, F.struct(at, tie)).alias("last"), F.coalesce(F.avg(value), F.lit(0.0)).alias("average"),
    )


def rate(hits, total):
    """A ratio as a column, 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(hits, total), F.lit(0.0))


def external_changes(events: DataFrame) -> DataFrame:
    """Events that no governed operation caused, by workspace and kind."""
    return events.where(F.col("correlation_id").isNull()).groupBy("workspace_id", "kind").agg(F.countDistinct("sequence").alias("events"))


def affected(changed: DataFrame, citing: DataFrame) -> DataFrame:
    """Rows of ``citing(id, resource_id)`` whose resource is among ``changed(resource_id)``."""
    return citing.join(changed.select("resource_id").distinct(), "resource_id", "left_semi")


def lease_conflicts(leases: DataFrame, wanted: DataFrame, now) -> DataFrame:
    """``request_id, lease_id, paths``: active, unexpired leases whose scope meets a request's paths.

    Both scopes are exploded and joined on the path, so that no pair of leases without a common path is looked at.
    """
    active = leases.where((F.col("status") == "active") & (F.col("expires_at") > now)).select(F.col("lease_id"), F.explode(F.array_distinct("scope")).alias("path"))
    asked = wanted.select("request_id", F.explode(F.array_distinct("paths")).alias("path"))
    both = asked.join(active, "path").where(F.col("request_id") != F.col("lease_id"))
    # The paths of one request that one lease holds: at most the request's own.
    return both.groupBy("request_id", "lease_id").agg(F.sort_array(F.collect_set("path")).alias("paths"))


def observer_actions(events: DataFrame) -> DataFrame:
    """``workspace_id, sequence, action`` of each event ``(workspace_id, sequence, kind, resource_id)``, each once.

    A jump in the sequence, an uncertain move or a relocation asks for a ``full_scan``; a change of a resource is
    ``external`` or ``governed`` by its kind; other events ask for ``none``. Jumps are found in blocks, see :func:`gaps`.
    """
    jumps = gaps(events).select("workspace_id", F.col("current").alias("sequence"), F.lit(True).alias("jump"))
    rows = events.select("workspace_id", "sequence", "kind", "resource_id").join(jumps, ["workspace_id", "sequence"], "left")
    action = F.when(F.col("jump") | F.col("kind").isin("resource_ambiguous", "workspace_relocated"), "full_scan").when(F.col("resource_id").isNull(), "none").when(F.col("kind") == "external_change", "external").otherwise("governed")
    return rows.select("workspace_id", "sequence", action.alias("action"))
