"""Streams of file changes: what changed, after which quiet, and what it asks for."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodemill.operators.changesets import invalidated_claims

_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def changed_files(spark: SparkSession, root: str, per_batch: int = 1000) -> DataFrame:
    """``path, seen_at, size_bytes, content_hash`` of files below a folder as they come, as a stream."""
    raw = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(root)
    return raw.select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), F.col("modificationTime").alias("seen_at"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("content_hash"))


def _settle(quiet_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, seen = state.get
            state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(last, unit="ms"), seen)], columns=["path", "last_seen", "events"])
            return
        last, seen = state.get if state.exists else (None, 0)
        out = []
        for ms in sorted(int(x) for batch in batches for x in batch["ms"]):
            if last is not None and ms > last + quiet_ms:
                out.append((key[0], pd.Timestamp(last, unit="ms"), seen))
                last, seen = ms, 0
            last, seen = ms if last is None else max(last, ms), seen + 1
        state.update((last, seen))
        state.setTimeoutTimestamp(max(last + quiet_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["path", "last_seen", "events"]).astype({"last_seen": "datetime64[ms]"})

    return run


def settled(events: DataFrame, quiet: str = "2 seconds", quiet_ms: int = 2000) -> DataFrame:
    """``path, last_seen, events`` of each path once no event of it has come for a quiet time, by event time.

    ``events(path, seen_at)`` is a stream. Rows without path or time are left out; an event after the quiet begins anew.
    """
    rows = events.where(F.col("path").isNotNull() & F.col("seen_at").isNotNull()).withWatermark("seen_at", quiet)
    rows = rows.select("path", "seen_at", F.unix_millis("seen_at").alias("ms"))
    return rows.groupBy("path").applyInPandasWithState(_settle(quiet_ms), "path string, last_seen timestamp, events bigint", "last bigint, seen bigint", "append", GroupStateTimeout.EventTimeTimeout)


def _act(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat([b for b in batches]).sort_values("sequence", kind="stable").drop_duplicates("sequence")
    out = []
    for n, kind, resource in zip(rows["sequence"].tolist(), rows["kind"], rows["resource_id"]):
        if last is not None and n <= last:
            continue  # a repeat, or late: the scan that its gap asked for has seen it
        if (last is not None and n != last + 1) or kind in ("resource_ambiguous", "workspace_relocated", "overflow"):
            action = "full_scan"
        elif resource is None:
            action = "none"
        else:
            action = "external" if kind == "external_change" else "governed"
        out.append((key[0], n, action))
        last = n
    if last is not None:
        state.update((last,))
    yield pd.DataFrame(out, columns=["workspace_id", "sequence", "action"])


def actions(events: DataFrame) -> DataFrame:
    """``workspace_id, sequence, action`` as a stream: what each event asks of the reconciler, see the batch query of the same name.

    The state of a workspace is its highest number; numbers at or below it are passed over.
    """
    rows = events.where(F.col("workspace_id").isNotNull() & F.col("sequence").isNotNull()).select("workspace_id", "sequence", "kind", "resource_id")
    return rows.groupBy("workspace_id").applyInPandasWithState(_act, "workspace_id string, sequence bigint, action string", "last bigint", "append", GroupStateTimeout.NoTimeout)


def invalidating(claims: DataFrame, evidence: DataFrame, into: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A handler of batches of changed resources: hands the claims that they invalidate, each once a batch, to ``into``."""

    def handle(batch: DataFrame, number: int) -> None:
        into(invalidated_claims(claims, evidence, batch.select("resource_id").where(F.col("resource_id").isNotNull())), number)

    return handle
