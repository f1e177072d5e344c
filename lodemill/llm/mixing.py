"""Mixing sources to target weights by Pfair scheduling.

Each source is laid out as a line of blocks of equally many tokens. Block k of a source of weight w may be taken from
slot floor(k / w) on and must be taken before slot ceil((k + 1) / w); earliest deadline first fills one block a slot.
Weights are whole numbers, so the schedule repeats: after each period every source has exactly its share, and in between
it is less than one block off. When a source has given all it may, a new phase begins in which the others keep their
weights among each other, so no slot stays empty. Only one period a phase is ever computed by hand; where a document
comes in its source's line is a prefix sum, made in buckets so that a large source spreads over many tasks.
"""

from __future__ import annotations

import base64
import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodemill.session import Scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that parts a text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODINGS: dict = {}


def _encoding(path: str, lines: bytes):
    if path not in _ENCODINGS:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}
        _ENCODINGS[path] = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def with_tokens(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """The other columns and ``tokens``: how many tokens the text has under a vocabulary file of ranks; 0 for null.

    The driver reads the file, which is as large as a vocabulary is, and sends it to the tasks.
    """
    with open(tokenizer, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(tokenizer, ranks.value)
        for batch in texts:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in batch], dtype="int64")

    return docs.withColumn("tokens", count(F.col(text))).drop(text)


def whole_weights(shares: dict[str, float], most_period: int = 100_000) -> dict[str, int]:
    """Blocks of each source in a period: whole numbers in the ratio of the shares as they are written.

    A ratio that takes a period of more than ``most_period`` blocks is rounded to one of about that, in which every
    positive share has one block at least, so that no source is left out.
    """
    exact = {s: Fraction(repr(float(x))) for s, x in shares.items() if x > 0}
    total = sum(exact.values())
    unit = Fraction(1, math.lcm(*(x.denominator for x in exact.values()))) * math.gcd(*(int(x * math.lcm(*(y.denominator for y in exact.values()))) for x in exact.values())) if exact else Fraction(1)
    if exact and total / unit > most_period:
        return {s: max(1, round(exact[s] / total * most_period)) if s in exact else 0 for s in shares}
    return {s: int(exact[s] / unit) if s in exact else 0 for s in shares}


def one_period(counts: dict[str, int]) -> list[str]:
    """The source of each slot of a period, by earliest deadline first among the released blocks."""
    period = sum(counts.values())
    later = [(0, s, 0) for s, n in sorted(counts.items()) if n]
    heapq.heapify(later)
    ready: list[tuple[int, str, int]] = []
    slots = []
    for slot in range(period):
        while later and later[0][0] <= slot:
            _, s, k = heapq.heappop(later)
            heapq.heappush(ready, (-(-(k + 1) * period // counts[s]), s, k))
        _, s, k = heapq.heappop(ready)
        slots.append(s)
        if k + 1 < counts[s]:
            heapq.heappush(later, ((k + 1) * period // counts[s], s, k + 1))
    return slots


def source_key(column):
    return F.lower(F.trim(column))


def plan_mix(docs: DataFrame, targets: DataFrame) -> list[dict]:
    """What each source of ``targets`` has and gives, one row a source.

    Needed are ``target_share`` of the tokens of all documents taken once; a source gives that or, if it has less, all
    its tokens ``max_repeats`` times. Sources are compared without regard to case and blanks around them; repeated rows
    of a source take the largest share and repeats, null ones count as 0. The result has as many rows as ``targets``.
    """
    wanted = targets.groupBy(source_key("source").alias("source")).agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats")).where(F.col("source").isNotNull())
    have = docs.groupBy(source_key("source").alias("s")).agg(F.sum("tokens").alias("once"))
    total = have.agg(F.coalesce(F.sum("once"), F.lit(0))).first()[0]
    rows = wanted.join(have, F.col("source") == F.col("s"), "left").select("source", "target_share", "max_repeats", F.coalesce("once", F.lit(0)).alias("once")).collect()
    out = []
    for r in sorted(rows, key=lambda r: r.source):
        capacity, needed = r.once * max(0, r.max_repeats), r.target_share * total
        out.append(r.asDict() | {"capacity": capacity, "needed": needed, "quota": min(float(capacity), needed), })
    return out


def phases(weights: dict[str, int], blocks: dict[str, int]) -> dict[str, list[tuple[int, int, int, list[int]]]]:
    """Of each source its phases: (first block, first slot, period, slots of a period that are its own).

    A phase lasts until the first of its sources has placed all its ``blocks``; the others go on with their weights.
    """
    left = {s: n for s, n in blocks.items() if n > 0 and weights.get(s)}
    out: dict[str, list] = {s: [] for s in left}
    start = 0
    while left:
        live = {s: weights[s] for s in left}
        period = sum(live.values())
        own: dict[str, list[int]] = {s: [] for s in live}
        for slot, s in enumerate(one_period(live)):
            own[s].append(slot)
        length = min((left[s] - 1) // n * period + own[s][(left[s] - 1) % n] + 1 for s, n in live.items())
        full, rest = divmod(length, period)
        for s, n in live.items():
            out[s].append((blocks[s] - left[s], start, period, own[s]))
            left[s] -= full * n + bisect_left(own[s], rest)
        left = {s: n for s, n in left.items() if n}
        start += length
    return out


def mix(docs: DataFrame, targets: DataFrame, block_tokens: int = 4096, most_period: int = 100_000, bucket_docs: int = 50_000) -> tuple[DataFrame, list[dict]]:
    """The mix in order, ``slot, source, doc_id, copy, start, tokens``, and the plan of :func:`plan_mix`.

    A document is taken where its place in the source's line begins below the source's quota; its copies follow one
    pass behind another. Documents of no or another source, or without tokens, are not in the mix. ``docs`` has
    ``doc_id, source, tokens`` and should be a written table, as it is read several times.
    """
    spark = docs.sparkSession
    plan = plan_mix(docs, targets)
    weights = whole_weights({r["source"]: max(0.0, r["target_share"]) for r in plan}, most_period)
    placed_in = phases(weights, {r["source"]: math.ceil(r["quota"] / block_tokens) for r in plan})
    taken = [(r["source"], r["once"], r["quota"], int(-(-r["quota"] // r["once"])), placed_in[r["source"]]) for r in plan if r["quota"] > 0]
    schedule = spark.createDataFrame(taken, "source string, once bigint, quota double, copies int, phases array<struct<first:bigint,start:bigint,period:bigint,slots:array<int>>>")

    lines = docs.where(F.col("tokens") > 0).select(source_key("source").alias("source"), "doc_id", "tokens", F.xxhash64("doc_id").alias("h"))
    lines = lines.join(schedule.select(F.col("source").alias("s")), F.col("source") == F.col("s"), "left_semi")
    buckets = max(16, docs.count() // bucket_docs)
    lines = lines.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sums = lines.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(sums, (F.col("source") == F.col("s")) & (F.col("bucket") == F.col("b"))).select("source", "doc_id", "tokens", (F.col("before") + F.col("inside")).alias("place"))
    copies = (
        placed.join(schedule.withColumnRenamed("source", "s"), F.col("source") == F.col("s"))
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .withColumn("start", F.col("copy") * F.col("once") + F.col("place"))
        .where(F.col("start") < F.col("quota"))
        .withColumn("block", F.floor(F.col("start") / block_tokens))
        .withColumn("phase", F.element_at(F.filter("phases", lambda p: p["first"] <= F.col("block")), -1))
    )
    block, size = F.col("block") - F.col("phase.first"), F.size("phase.slots")
    slot = F.col("phase.start") + F.floor(block / size) * F.col("phase.period") + F.element_at("phase.slots", (block % size + 1).cast("int"))
    return copies.select(slot.alias("slot"), "source", "doc_id", "copy", "start", "tokens"), plan


def reached_shares(mixed: DataFrame, plan: list[dict]) -> DataFrame:
    """One row a source of the plan: what it was to give and what it gives of the mix; ``short`` if that is less than needed."""
    got = mixed.groupBy(F.col("source").alias("s")).agg(F.sum("tokens").alias("got"), F.countDistinct("doc_id").alias("docs"), (F.max("copy") + 1).alias("passes"))
    wanted = mixed.sparkSession.createDataFrame([(r["source"], r["target_share"], r["max_repeats"], r["capacity"], r["needed"]) for r in plan], "source string, target_share double, max_repeats int, capacity bigint, needed double")
    both = wanted.join(got, F.col("source") == F.col("s"), "left").withColumn("tokens", F.coalesce("got", F.lit(0)))
    both = both.select("source", "target_share", "max_repeats", "capacity", "needed", (F.col("tokens") < F.col("needed")).alias("short"), "tokens", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("passes", F.lit(0)).alias("passes"))
    return both.withColumn("share", F.coalesce(F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy(F.lit(1)))), F.lit(0.0)))


def counted(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, tokens`` as a written table, each row of the corpus once."""
    return Scratch(docs.sparkSession).write(with_tokens(docs.select("doc_id", "source", "text"), tokenizer=tokenizer))
