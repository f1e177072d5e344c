"""Content-addressed blobs as rows: put, released, expired, scanned for damage and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def put(base: DataFrame, new: DataFrame) -> DataFrame:
    """``hash, content, byte_count, references, retained_until``: the store after ``new(content, retained_until)``.

    Equal contents are one blob whose references add up and which is kept until the latest time asked for. Null contents
    are not stored.
    """
    rows = new.where(F.col("content").isNotNull()).select(F.sha2("content", 256).alias("hash"), "content", F.length("content").cast("bigint").alias("byte_count"), F.lit(1).cast("bigint").alias("references"), "retained_until")
    both = base.select("hash", "content", "byte_count", "references", "retained_until").unionByName(rows)
    return both.groupBy("hash").agg(F.first("content", True).alias("content"), F.max("byte_count").alias("byte_count"), F.sum("references").alias("references"), F.max("retained_until").alias("retained_until"))


def release(store: DataFrame, gone: DataFrame) -> DataFrame:
    """The store with a reference less for each row of ``gone(hash)``; references never fall below none."""
    less = gone.groupBy("hash").agg(F.count("*").alias("less"))
    return store.join(less, "hash", "left").withColumn("references", F.greatest(F.lit(0), F.col("references") - F.coalesce("less", F.lit(0)))).drop("less")


def kept(store: DataFrame, now: Column) -> DataFrame:
    """The store without the blobs that nothing refers to and whose time is over; a null time never ends."""
    return store.where((F.col("references") > 0) | F.col("retained_until").isNull() | (F.col("retained_until") > now))


def damaged(store: DataFrame) -> DataFrame:
    """Blobs whose content is not what their hash says, missing contents included."""
    return store.where(~F.sha2("content", 256).eqNullSafe(F.col("hash")))


def statistics(store: DataFrame, *by: str) -> DataFrame:
    """Sound blobs, their bytes, and damaged ones."""
    sound = F.sha2("content", 256).eqNullSafe(F.col("hash"))
    return store.groupBy(*by).agg(F.count_if(sound).alias("blobs"), F.coalesce(F.sum(F.when(sound, F.col("byte_count"))), F.lit(0)).alias("bytes"), F.count_if(~sound).alias("damaged"))


def recovery_statistics(store: DataFrame, now: Column, *by: str) -> DataFrame:
    """Blobs, bytes, expired ones, and what one copy less of the mean blob each would save."""
    n = F.countDistinct("hash")
    return store.groupBy(*by).agg(F.count("*").alias("blobs"), F.coalesce(F.sum("byte_count"), F.lit(0)).alias("bytes"), F.count_if(F.col("retained_until") <= now).alias("expired"), F.coalesce(F.floor(F.try_divide(F.sum("byte_count"), n) * F.greatest(F.lit(0), n - 1)), F.lit(0)).cast("bigint").alias("savings"))
