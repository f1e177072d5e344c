"""Applying a change feed of inserts, updates and deletes to a base table as a signed multiset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# The kinds of events that change a resource, and the status each leaves.
STATUS_OF_KIND = {
    "resource_created": "current",
    "resource_updated": "current",
    "resource_moved": "current",
    "external_change": "current",
    "resource_ambiguous": "ambiguous",
    "resource_deleted": "deleted",
}

_IMAGE = "struct<at:struct<sequence:bigint,base:int>,value:string>"


def changes(events: DataFrame) -> DataFrame:
    """The feed as one row per event that changes a resource.

    Columns ``resource_id, at(sequence, base), status, sets_path, path``. Rows with equal workspace, sequence and
    resource are one event, whichever id they carry; where such rows disagree, the last kind by name and then the last
    path holds. Events without resource, sequence or known kind change nothing;
    an empty or missing path leaves the path.
    """
    status = F.create_map(*[F.lit(x) for kind_status in STATUS_OF_KIND.items() for x in kind_status])
    path = F.try_element_at(F.col("detail"), F.lit("path"))
    return (
        events.where(F.col("resource_id").isNotNull() & F.col("sequence").isNotNull() & F.col("kind").isin(*STATUS_OF_KIND))
        .select("workspace_id", "sequence", "resource_id", "kind", F.when(path != "", path).alias("path"))
        .groupBy("workspace_id", "sequence", "resource_id")
        .agg(F.max(F.struct("kind", "path")).alias("c"))
        .select(
            "resource_id",
            F.struct(F.col("sequence"), F.lit(0).alias("base")).alias("at"),
            status[F.col("c.kind")].alias("status"),
            (F.col("c.path").isNotNull() | (F.col("c.kind") == "resource_deleted")).alias("sets_path"),
            F.when(F.col("c.kind") != "resource_deleted", F.col("c.path")).alias("path"),
        )
    )


def base_rows(resources: DataFrame) -> DataFrame:
    """The base table in the form of :func:`changes`: of several rows of an id the one with the highest last_sequence.

    It replaces whatever the feed says up to that number, so it is ordered behind the event of the same number.
    A null last_sequence reflects no event; rows without id are no resources.
    """
    return (
        resources.where(F.col("id").isNotNull())
        .groupBy(F.col("id").alias("resource_id"))
        .agg(F.max(F.struct(F.coalesce("last_sequence", F.lit(-1).cast("long")).alias("s"), "updated_at", "state_version", "status", "current_path")).alias("b"))
        .select(
            "resource_id",
            F.struct(F.col("b.s").alias("sequence"), F.lit(1).alias("base")).alias("at"),
            F.col("b.status").alias("status"),
            F.lit(True).alias("sets_path"),
            F.col("b.current_path").alias("path"),
        )
    )


def signed_images(log: DataFrame, block_bits: int = 12) -> DataFrame:
    """Per change a plus-one after-image and a minus-one before-image: ``resource_id, status, path, sign``.

    What a change finds is a prefix scan over the resource's changes. It runs in blocks of ``2**block_bits`` sequence
    numbers, with the summaries of the blocks scanned first, so that the changes of one busy resource spread over many
    tasks.
    """
    at = F.col("at")
    log = log.withColumn("block", F.shiftright(at["sequence"], block_bits))
    summary = log.groupBy("resource_id", "block").agg(
        F.max(F.struct(at.alias("at"), F.col("status").alias("value"))).alias("last_status"),
        F.max(F.when(F.col("sets_path"), F.struct(at.alias("at"), F.col("path").alias("value")))).alias("last_path"),
    )
    before = Window.partitionBy("resource_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        "resource_id",
        "block",
        F.max("last_status").over(before).alias("s"),
        F.max("last_path").over(before).alias("p"),
    ).where(F.col("s").isNotNull())
    columns = ["resource_id", "block", "at", "carried", "s", "p"]
    rows = log.select(
        "resource_id",
        "block",
        "at",
        F.lit(False).alias("carried"),
        F.struct(at.alias("at"), F.col("status").alias("value")).cast(_IMAGE).alias("s"),
        F.when(F.col("sets_path"), F.struct(at.alias("at"), F.col("path").alias("value")).cast(_IMAGE)).alias("p"),
    ).unionByName(carried.select("resource_id", "block", F.col("s.at").alias("at"), F.lit(True).alias("carried"), F.col("s").cast(_IMAGE).alias("s"), F.col("p").cast(_IMAGE).alias("p")).select(*columns))
    scan = Window.partitionBy("resource_id", "block").orderBy("at")
    seen = scan.rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.select("resource_id", "carried", "s", F.max("p").over(seen).alias("path"), F.lag("s").over(scan).alias("was"), F.max("p").over(scan.rowsBetween(Window.unboundedPreceding, -1)).alias("was_path"))
        .where(~F.col("carried"))
        .select(
            "resource_id",
            F.explode(
                F.array(
                    F.struct(F.lit(1).alias("sign"), F.col("s.value").alias("status"), F.col("path.value").alias("path")),
                    F.when(F.col("was").isNotNull(), F.struct(F.lit(-1).alias("sign"), F.col("was.value").alias("status"), F.col("was_path.value").alias("path"))),
                )
            ).alias("i"),
        )
        .where(F.col("i").isNotNull())
        .select("resource_id", "i.status", "i.path", "i.sign")
    )


def apply_changes(resources: DataFrame, events: DataFrame, block_bits: int = 12) -> DataFrame:
    """The state of every resource after all events: ``resource_id, status, current_path``.

    Multiplicities of the images are summed per (resource, status, path); the rows that stay positive are the state.
    Partial sums are made before the shuffle, so a resource that flips between few states costs little. Nulls, empty
    tables and repeated rows have the results that :func:`changes` and :func:`base_rows` state; further columns of the
    inputs are ignored.
    """
    log = changes(events).unionByName(base_rows(resources))
    return (
        signed_images(log, block_bits)
        .groupBy("resource_id", "status", "path")
        .agg(F.sum("sign").alias("multiplicity"))
        .where(F.col("multiplicity") > 0)
        .select("resource_id", "status", F.col("path").alias("current_path"))
    )


def event_schema() -> T.StructType:
    return T._parse_datatype_string(
        "id string, workspace_id string, sequence bigint, kind string, occurred_at timestamp, resource_id string,"
        " correlation_id string, detail map<string,string>, received_at timestamp"
    )


def resource_schema() -> T.StructType:
    return T._parse_datatype_string(
        "id string, workspace_id string, current_path string, status string, state_version bigint, created_at timestamp,"
        " updated_at timestamp, last_sequence bigint"
    )
