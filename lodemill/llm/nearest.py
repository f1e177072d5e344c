"""Most similar vectors for every vector, by vantage-point trees per shard.

A tree over a bounded sample parts the space into shards. Each vector first searches its own shard; the distance of its
k-th hit then tells which other shards it must visit, by the triangle inequality relaxed by ``factor``. Every shard has
a tree of its own over all its vectors. Equal vectors are one point with the least of their ids; points are numbered in
the order of those ids, so equal distances go to the smaller id.

A shard is held in one task at a time, its visitors stream by. A shard that would be larger than ``most`` is parted by
hash, and its points visit all parts. Distances are squared Euclidean in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodemill.llm.vptree import Hits, Tree, search
from lodemill.session import Scratch

SAMPLE, MOST_SAMPLE = 20_000, 320_000
SHARD = 4096
LEAST_SHARDS = 16
BUCKET = 256
FACTOR = 0.4


def _usable(dimension: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, rows = [], []
            for rid, v in zip(batch["id"], batch["vector"]):
                if rid is not None and v is not None and len(v) == dimension:
                    ids.append(rid)
                    rows.append(v)
            x = np.array(rows, dtype=np.float32).reshape(-1, dimension) + np.float32(0)  # no negative zeros
            fit = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            packed = [row.tobytes() for row in x[fit]]
            yield pd.DataFrame({"id": [i for i, f in zip(ids, fit) if f], "h": [xxhash.xxh3_128_digest(p) for p in packed], "vec": packed})

    return run


def _array(packed) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype="<f4").reshape(len(packed), -1).astype(np.float64)


def shard_tree(vectors: list[bytes], shards: int, k: int, factor: float) -> tuple[Tree, float]:
    """The tree that parts the space into about ``shards`` shards, and the margin it kept clear around its radii."""
    fitted = _array(list(dict.fromkeys(vectors)))
    margin = factor * _typical_reach(fitted, k)
    return Tree(fitted, -(-len(fitted) // max(1, min(shards, len(fitted) // 16))), margin), margin


def nearest_points(points: DataFrame, top, margin: float, k: int, factor: float = FACTOR, bucket: int = BUCKET, most: int = 65_536, scratch: Scratch | None = None) -> DataFrame:
    """``no, hits array<struct<square, no>>``: the k nearest other points of each of ``points(no, vec, leaf)``.

    ``vec`` is the packed little-endian float32 vector, ``leaf`` where the broadcast tree ``top`` puts it; no two points
    should be equal. ``points`` is read several times and should be a written table; if ``scratch`` wrote it, it is
    dropped when the homes are searched, which keep all that is needed of it.
    """
    spark = points.sparkSession
    scratch = scratch or Scratch(spark)
    sizes = points.groupBy("leaf").count().collect()  # one row a shard of the tree
    parts = {r["leaf"]: -(-r["count"] // most) for r in sizes}
    known = spark.sparkContext.broadcast(parts)
    split = [(leaf, n) for leaf, n in parts.items() if n > 1]
    of = F.element_at(F.create_map(*[F.lit(x) for pair in split for x in pair]), F.col("leaf")) if split else F.lit(None).cast("bigint")
    home = points.select("no", "vec", "leaf", F.pmod(F.xxhash64("no"), F.coalesce(of.cast("bigint"), F.lit(1).cast("bigint"))).alias("part"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(r["count"] for r in sizes) // SHARD))  # so that no task grows with the input
    keyed = home.repartition(tasks, "leaf", "part").sortWithinPartitions("leaf", "part", "no")
    first = scratch.write(keyed.mapInPandas(_search_home(k, factor, bucket, margin), "leaf bigint, part bigint, no bigint, vec binary, reach double, square array<double>, number array<bigint>"))
    scratch.drop(points)

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            q, leaf = top.value.near(_array(batch["vec"].tolist()), batch["reach"].to_numpy(), factor)
            of = np.array([known.value.get(x, 0) for x in leaf], dtype=np.int64)
            q, leaf, to = np.repeat(q, of), np.repeat(leaf, of), np.arange(of.sum()) - np.repeat(np.cumsum(of) - of, of)
            away = (leaf != batch["leaf"].to_numpy()[q]) | (to != batch["part"].to_numpy()[q])
            q = q[away]
            yield pd.DataFrame({"leaf": leaf[away], "part": to[away], "no": batch["no"].to_numpy()[q], "vec": batch["vec"].to_numpy()[q], "reach": batch["reach"].to_numpy()[q]})

    kinds = "leaf bigint, part bigint, no bigint, vec binary, reach double"
    guests = first.select("leaf", "part", "no", "vec", "reach").mapInPandas(visits, kinds).withColumn("guest", F.lit(1))
    owners = first.select("leaf", "part", "no", "vec", F.lit(0.0).alias("reach"), F.lit(0).alias("guest"))
    mixed = owners.unionByName(guests).repartition(tasks, "leaf", "part").sortWithinPartitions("leaf", "part", "guest")
    more = mixed.mapInPandas(_search_guests(k, factor, bucket, margin), "no bigint, square array<double>, number array<bigint>")
    each = first.select("no", "square", "number").unionByName(more)
    hits = each.select("no", F.explode(F.arrays_zip("square", "number")).alias("h")).select("no", F.struct(F.col("h.square").alias("square"), F.col("h.number").alias("no")).alias("h"))
    # A point visits few shards and brings k hits from each, so its list is short.
    return hits.groupBy("no").agg(F.slice(F.sort_array(F.collect_list("h")), 1, k).alias("hits"))


def _typical_reach(points: np.ndarray, k: int) -> float:
    """The median distance to the k-th nearest of a few hundred points of the sample."""
    some = points[:: max(1, len(points) // 256)]
    square = np.maximum(0, (some**2).sum(1)[:, None] + (points**2).sum(1) - 2 * some @ points.T)
    return float(np.sqrt(np.median(np.partition(square, min(k, len(points) - 1), axis=1)[:, min(k, len(points) - 1)])))


def _shards(batches: Iterator[pd.DataFrame]):
    """(leaf, part), and its rows batch by batch, of rows sorted by both."""
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[["leaf", "part"]].to_numpy()
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for low, high in zip([0, *edges], [*edges, len(batch)]):
            yield tuple(keys[low]), batch.iloc[low:high]


def _lists(hits: Hits) -> tuple[list, list]:
    """Squares and numbers of the hits of each query, without those beyond its reach."""
    found = np.isfinite(hits.square) & (hits.square <= (hits.limit * (1 + 1e-12))[:, None] ** 2)
    return [s[f] for s, f in zip(hits.square, found)], [n[f] for n, f in zip(hits.number, found)]


def _search_home(k: int, factor: float, bucket: int, margin: float):
    def done(key: tuple, held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(held)
        x, numbers = _array(rows["vec"].tolist()), rows["no"].to_numpy()
        hits = Hits(len(x), k)
        search(Tree(x, bucket, margin), x, numbers, x, numbers, hits, factor)
        square, number = _lists(hits)
        out = pd.DataFrame({"leaf": key[0], "part": key[1], "no": numbers, "vec": rows["vec"].to_numpy(), "reach": np.sqrt(hits.square[:, -1]), "square": square, "number": number})
        for low in range(0, len(out), 10_000):
            yield out.iloc[low : low + 10_000]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for key, rows in _shards(batches):
            if key != at and held:
                yield from done(at, held)
                held = []
            at = key
            held.append(rows)
        if held:
            yield from done(at, held)

    return run


def _search_guests(k: int, factor: float, bucket: int, margin: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, tree, x, numbers = None, [], None, None, None
        for key, rows in _shards(batches):
            if key != at:
                at, held, tree = key, [], None
            owner = rows["guest"].to_numpy() == 0
            if owner.any():
                held.append(rows[owner])
            guests = rows[~owner]
            if not len(guests) or not held:
                continue
            if tree is None:
                all_rows = pd.concat(held)
                x, numbers = _array(all_rows["vec"].tolist()), all_rows["no"].to_numpy()
                tree = Tree(x, bucket, margin)
            hits = Hits(len(guests), k, guests["reach"].to_numpy())
            search(tree, x, numbers, _array(guests["vec"].tolist()), guests["no"].to_numpy(), hits, factor)
            square, number = _lists(hits)
            better = [n for n, x in enumerate(number) if len(x)]
            if better:
                yield pd.DataFrame({"no": guests["no"].to_numpy()[better], "square": [square[n] for n in better], "number": [number[n] for n in better]})

    return run


def nearest_vectors(items: DataFrame, item_id: str = "id", vector: str = "vector", k: int = 5, dimension: int = 64, factor: float = FACTOR, sample: int = SAMPLE, shard: int = SHARD, bucket: int = BUCKET, most: int = 65_536) -> DataFrame:
    """``id, rank, neighbour, square``: the k nearest other items of every item, ranked by distance, then id.

    Only vectors of exactly ``dimension`` finite values that are not all zero take part. Repeated rows count once; null
    ids take no part; other columns are ignored. Fewer than k others give fewer rows. With ``factor=1`` the result is
    exact; else a hit may be missed where a side of a tree was skipped. The tree over shards is fitted on ``sample`` vectors,
    or on sixteen a shard if those are more, at most ``MOST_SAMPLE``, which is enough for 20,000 shards; all are indexed.
    """
    spark = items.sparkSession
    scratch = Scratch(spark)
    named = items.select(F.col(item_id).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vector")).where(F.size("vector") == dimension)
    usable = named.mapInPandas(_usable(dimension), "id string, h binary, vec binary")
    members = scratch.write(usable.select("id", "h"))
    count = members.count()
    if count == 0:
        return spark.createDataFrame([], "id string, rank int, neighbour string, square double")
    shards = max(LEAST_SHARDS, -(-count // shard))
    sample = max(sample, min(16 * shards, MOST_SAMPLE))
    share = min(1.0, 0.9 * sample / count)
    some = named.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= int(share * (1 << 20))).mapInPandas(_usable(dimension), "id string, h binary, vec binary")
    rows = some.limit(sample).select("vec").collect() or usable.limit(1).select("vec").collect()
    tree, margin = shard_tree([r.vec for r in rows], shards, k, factor)
    top = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(leaf=top.value.route(_array(batch["vec"].tolist())))

    order = Window.partitionBy("h").orderBy("id")
    # k + 1 ids of equal vectors are all that any item can have among its hits.
    few = members.withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= k + 1)
    few = few.groupBy("h").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    lists = scratch.write(few.orderBy(F.element_at("ids", 1)).withColumn("no", F.monotonically_increasing_id()))
    body = usable.groupBy("h").agg(F.first("vec").alias("vec"))
    points = body.join(lists.select("h", "no"), "h").select("no", "vec").mapInPandas(place, "no bigint, vec binary, leaf bigint")
    found = nearest_points(scratch.write(points), top, margin, k, factor, bucket, most, scratch)
    points = lists
    ids = points.select(F.col("no").alias("n_no"), F.col("ids").alias("n_ids"))
    near = (
        found.select("no", F.explode("hits").alias("hit"))
        .join(ids, F.col("hit.no") == F.col("n_no"))
        .groupBy("no")
        .agg(F.collect_list(F.struct(F.col("hit.square").alias("square"), F.col("n_ids").alias("ids"))).alias("near"))
    )
    lists = points.select("no", "h", "ids").join(near, "no", "left")
    # The candidates of a point: its own ids at distance 0 and those of its k nearest points, (k + 1) ** 2 at most.
    own = F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("square"), i.alias("id")))
    others = F.flatten(F.transform(F.coalesce("near", F.array()), lambda x: F.transform(x["ids"], lambda i: F.struct(x["square"].alias("square"), i.alias("id")))))
    ranked = lists.select("h", F.slice(F.sort_array(F.concat(own, others)), 1, k + 1).alias("best"))
    each = members.select("h", "id").distinct().join(ranked, "h").select("id", F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, k).alias("best"))
    return each.select("id", F.posexplode("best").alias("pos", "b")).select("id", (F.col("pos") + 1).alias("rank"), F.col("b.id").alias("neighbour"), F.col("b.square").alias("square"))
