"""Budgets: first fit by priority, and packing of consecutive items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fold_first_fit(items: Column, budget: int) -> Column:
    """Running use and, per item, whether it fits into what is left; an item that does not fit uses nothing."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("taken"))

    def step(acc, item):
        fits = item["cost"] <= F.lit(budget) - acc["used"]
        return F.struct((acc["used"] + F.when(fits, item["cost"]).otherwise(0)).cast("long").alias("used"), F.concat(acc["taken"], F.array(fits)).alias("taken"))

    return F.aggregate(items, start, step)


def first_fit(items: DataFrame, group: str, budget: int, most: int = 4096) -> DataFrame:
    """``group, key, section, cost, included``: items by priority and order, each taken if it fits what is left.

    ``items`` has ``group, key, section, priority, ord, cost``. Skipped items are kept, marked as not included. A group
    is folded in one row and is a bounded list by contract (a brief); a group of more than ``most`` items is an error.
    Negative budgets are refused.
    """
    if budget < 0:
        raise ValueError("a budget can't be negative")
    rows = F.array_sort(F.collect_list(F.struct("priority", "ord", "key", "section", F.col("cost").cast("long").alias("cost"))))
    lists = items.groupBy(group).agg(F.count("*").alias("n"), rows.alias("items")).withColumn("items", F.when(F.col("n") <= most, F.col("items")).otherwise(F.raise_error(F.lit("too many items in a group"))))
    fitted = lists.withColumn("taken", _fold_first_fit(F.col("items"), budget)["taken"])
    each = fitted.select(group, F.explode(F.arrays_zip("items", "taken")).alias("x"))
    return each.select(group, F.col("x.items.key").alias("key"), F.col("x.items.section").alias("section"), F.col("x.items.cost").alias("cost"), F.col("x.taken").alias("included"))


def omitted_by_section(fitted: DataFrame, group: str) -> DataFrame:
    return fitted.where(~F.col("included")).groupBy(group, "section").agg(F.count("*").alias("omitted"))


def pack_consecutive(items: DataFrame, group: str, order: str, cost: str, target: int, block_bits: int = 12) -> DataFrame:
    """``group, order, pack``: consecutive items share a pack until its costs would exceed the target; a pack has one item at least.

    Where a pack begins depends on all before it, so a group is cut into blocks of ``2**block_bits`` numbers of its order (a
    whole number): each block first tells where it would leave off for every state it may be entered in, one row a block
    is scanned in order to find the states it is entered in, and then each block is walked. So a group with a third of
    all rows spreads over many tasks. Null groups are a group, null costs cost nothing.
    """
    rows = items.select(F.col(group).alias("g"), F.col(order).alias("o"), F.coalesce(F.col(cost).cast("long"), F.lit(0)).alias("c"), F.coalesce(F.shiftright(F.col(order).cast("bigint"), block_bits), F.lit(-(1 << 40))).alias("b"))
    kind, number = rows.schema["g"].dataType.simpleString(), rows.schema["o"].dataType.simpleString()
    full = target + 1  # a pack whose only item is too large takes no other

    def leave(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used, packs = None, None, None
        for batch in batches:
            out = []
            for g, b, c in zip(batch["g"].tolist(), batch["b"].tolist(), batch["c"].tolist()):
                g = _none(g)
                if at is None or at != (g, b):
                    if at is not None:
                        out.append((*at, used, packs))
                    at, used, packs = (g, b), np.append(np.arange(full + 1), -1), np.zeros(full + 2, dtype=np.int64)
                fits = (used + c <= target) | (used < 0)
                packs = packs + ~fits
                used = np.where(fits, np.minimum(np.maximum(used, 0) + c, full), min(c, full))
            yield pd.DataFrame(out, columns=["g", "b", "used", "packs"])
        yield pd.DataFrame([(*at, used, packs)] if at is not None else [], columns=["g", "b", "used", "packs"])

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, pack = (), 0, 0
        for batch in batches:
            out = []
            for g, b, used, packs in zip(batch["g"].tolist(), batch["b"].tolist(), batch["used"], batch["packs"]):
                if at != (_none(g),):
                    at, state, pack = (_none(g),), full + 1, 0
                out.append((_none(g), b, -1 if state == full + 1 else state, pack))
                state, pack = int(used[state]), pack + int(packs[state])
            yield pd.DataFrame(out, columns=["g", "b", "c", "pack"])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used, pack = 0, 0
        for batch in batches:
            out = []
            for g, o, c, start in zip(batch["g"].tolist(), batch["o"].tolist(), batch["c"].tolist(), batch["start"].tolist()):
                if start >= 0:
                    used, pack = c, start
                    continue
                if used >= 0 and used + c > target:
                    used, pack = 0, pack + 1
                used = max(used, 0) + c
                out.append((_none(g), o, pack))
            yield pd.DataFrame(out, columns=[group, order, "pack"])

    keyed = rows.repartition("g", "b").sortWithinPartitions("g", "b", "o")
    left = keyed.mapInPandas(leave, f"g {kind}, b bigint, used array<bigint>, packs array<bigint>")
    entered = left.repartition("g").sortWithinPartitions("g", "b").mapInPandas(enter, f"g {kind}, b bigint, c bigint, pack bigint")
    marks = entered.select("g", F.lit(0).cast(number).alias("o"), "c", "b", F.col("pack").alias("start"))
    both = rows.withColumn("start", F.lit(-1).cast("bigint")).unionByName(marks)
    ordered = both.repartition("g", "b").sortWithinPartitions("g", "b", F.desc("start"), "o")
    return ordered.mapInPandas(walk, f"{group} {kind}, {order} {number}, pack int")


def _none(value):
    return None if value is None or value != value else value
