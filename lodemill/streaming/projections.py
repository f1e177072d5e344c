"""Event streams: gaps in sequences and delivery to projections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _gaps(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    numbers = sorted({int(n) for batch in batches for n in batch["sequence"].dropna()})
    out = []
    for n in numbers:
        if last is not None and n > last + 1:
            out.append((key[0], last, n))
        last = n if last is None else max(last, n)
    if last is not None:
        state.update((last,))
    yield pd.DataFrame(out, columns=["workspace_id", "previous", "current"])


def sequence_gaps(events: DataFrame) -> DataFrame:
    """``workspace_id, previous, current`` as a stream: where a sequence skips numbers, in the order of arrival by batch.

    The state of a workspace is its highest number. Numbers at or below it are repeats or late and are no gap.
    """
    rows = events.where(F.col("workspace_id").isNotNull()).select("workspace_id", "sequence")
    return rows.groupBy("workspace_id").applyInPandasWithState(_gaps, "workspace_id string, previous long, current long", "last long", "append", GroupStateTimeout.NoTimeout)


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, as long as its repeats come within ``late`` of each other by event time."""
    return events.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["workspace_id", "sequence"])


def deliver(events: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands every batch to a handler, at least once and in order; the checkpoint is the offset.

    A handler that raises leaves the offset, so its batch comes again under the same number: it should write by
    batch number or key.
    """
    return events.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """A handler that writes each batch into its own folder, so that a batch handed over again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def expired(leases: DataFrame, now) -> DataFrame:
    """Leases with their status as of ``now``: an active one that has run out is expired, at its very second."""
    return leases.withColumn("status", F.when((F.col("status") == "active") & (F.col("expires_at") <= now), "expired").otherwise(F.col("status")))
