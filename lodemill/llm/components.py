"""Consolidating pairwise matches into groups.

Method: rake and compress. Vertices of degree one are stripped and chains of degree-two vertices are compressed by list
ranking until neither is left; the reduced core, where every vertex has three neighbours or more, is solved by
alternating large-star and small-star steps; the stripped vertices then get the labels of what they hung on.

No step joins on the key of a busy vertex, but for the star steps of the core and the final labels, whose other side
has one row per key, so that adaptive skew joins split them. Every loop ends by counts taken while rows are written
to the scratch folder, not by collected links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.session import Scratch


def _arcs(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("x")).select("x.a", "x.b")


def _low_degree(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, dict]:
    """The vertices with one or two neighbours, ``a, n, x, y`` with x <= y the neighbours, and how many have one and two."""
    degrees = _arcs(edges).groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("x"), F.max("b").alias("y"))
    return scratch.measured(degrees.where(F.col("n") <= 2), ones=F.count_if(F.col("n") == 1), twos=F.count_if(F.col("n") == 2))


def _rake(low: DataFrame) -> DataFrame:
    """Degree-one vertices and what they hang on: ``v, parent, e_u, e_v``. Of an isolated pair the larger one hangs on the smaller."""
    leaves = low.where(F.col("n") == 1)
    pairs = leaves.groupBy(F.least("a", "x").alias("e_u"), F.greatest("a", "x").alias("e_v")).agg(F.max("a").alias("v"))
    return pairs.select("v", F.when(F.col("v") == F.col("e_v"), F.col("e_u")).otherwise(F.col("e_v")).alias("parent"), "e_u", "e_v")


def _rank_chains(low: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """List ranking of the chains of degree-two vertices by pointer jumping.

    Every such vertex v has two states (v, came from x) and (v, came from y); a state points at the state of the vertex
    it moves on to, or ends at an anchor, which is no degree-two vertex. Gives the states ``v, frm, at, at_frm, rank,
    low, done`` and the vertices. The least id passed on the way tells the rings, whose states never end: a round in
    which no state ends and no least id falls is the last, since a list longer than the jump always has such a state.
    """
    middle = low.where(F.col("n") == 2)
    states = middle.select(
        F.col("a").alias("v"),
        F.explode(F.array(F.struct(F.col("x").alias("frm"), F.col("y").alias("at")), F.struct(F.col("y").alias("frm"), F.col("x").alias("at")))).alias("s"),
    ).select("v", "s.frm", "s.at", F.col("v").alias("at_frm"), F.lit(1).cast("long").alias("rank"), F.col("v").alias("low"), F.lit(False).alias("done"), F.lit(True).alias("moved"))
    states = scratch.write(states)
    while True:
        ahead = states.select(F.col("v").alias("j_at"), F.col("frm").alias("j_frm"), F.col("at").alias("n_at"), F.col("at_frm").alias("n_frm"), F.col("rank").alias("n_rank"), F.col("low").alias("n_low"), F.col("done").alias("n_done"))
        found = F.col("j_at").isNotNull()
        stepped = states.join(ahead, (states["at"] == ahead["j_at"]) & (states["at_frm"] == ahead["j_frm"]) & ~states["done"], "left").select(
            "v",
            "frm",
            F.when(found, F.col("n_at")).otherwise(F.col("at")).alias("at"),
            F.when(found, F.col("n_frm")).otherwise(F.col("at_frm")).alias("at_frm"),
            F.when(found, F.col("rank") + F.col("n_rank")).otherwise(F.col("rank")).alias("rank"),
            F.when(found, F.least("low", "n_low")).otherwise(F.col("low")).alias("low"),
            (F.col("done") | ~found | F.coalesce("n_done", F.lit(False))).alias("done"),
            (~F.col("done") & (~found | F.coalesce("n_done", F.lit(False)) | (F.col("n_low") < F.col("low")))).alias("moved"),
        )
        after, told = scratch.measured(stepped, moved=F.count_if("moved"))
        scratch.drop(states)
        states = after
        if not told["moved"]:
            return states, middle


def _compress(low: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """What chain vertices hang on (``v, parent``), and the edges between the two ends of each chain (``u, v``)."""
    states, _ = _rank_chains(low, scratch)
    ends = states.groupBy("v").agg(
        F.min(F.when(F.col("done"), F.col("at"))).alias("p"),
        F.max(F.when(F.col("done"), F.col("at"))).alias("q"),
        F.min("low").alias("ring"),
    )
    ends = scratch.write(ends)
    parents = ends.select("v", F.coalesce("p", "ring").alias("parent")).where(F.col("v") != F.col("parent"))
    bridges = ends.where(F.col("p") < F.col("q")).select(F.col("p").alias("u"), F.col("q").alias("v")).distinct()
    return parents, bridges


def _core(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Large-star and small-star steps until the edges are stars: ``v, parent`` with the least id as parent."""
    stars = scratch.write(edges.select(F.col("v").alias("hi"), F.col("u").alias("lo")))
    shape = None
    while True:
        arcs = stars.select(F.explode(F.array(F.struct(F.col("hi").alias("a"), F.col("lo").alias("b")), F.struct(F.col("lo").alias("a"), F.col("hi").alias("b")))).alias("x")).select("x.a", "x.b")
        least = arcs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = arcs.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("k")).select(F.col("b").alias("hi"), F.col("m").alias("lo")).distinct()
        large = scratch.write(large)
        down = large.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("k"), "m")
        small = large.join(down, F.col("hi") == F.col("k")).select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("x")).select("x.*")
        small, now = scratch.measured(small.where(F.col("hi") != F.col("lo")).distinct(), rows=F.count("*"), hash=F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")))
        scratch.drop(stars, large)
        stars = small
        if now == shape:
            return stars.select(F.col("hi").alias("v"), F.col("lo").alias("parent"))
        shape = now


def link_groups(links: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Every id of a link with the group of all ids linked to it, directly or through others: ``member, group_id``.

    group_id is the least id of the group. Links with a null end or from an id to itself link nothing; repeated and
    reversed links count once; an empty table has no groups. Other columns are ignored.
    """
    scratch = Scratch(links.sparkSession)
    edges = links.where(F.col(a) != F.col(b)).groupBy(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).agg(F.lit(1)).select("u", "v")
    edges, told = scratch.measured(edges, rows=F.count("*"))
    first, steps, left = edges, [], told["rows"]
    while left:
        low, told = _low_degree(edges, scratch)
        if not told["ones"] and not told["twos"]:
            steps.append(_core(edges, scratch))
            break
        if told["ones"]:
            raked = scratch.write(_rake(low))
            steps.append(raked.select("v", "parent"))
            edges, left = _without(edges, raked.select("e_u", "e_v"), None, first, scratch)
            if not left:
                break
            low, told = _low_degree(edges, scratch)
        if not told["twos"]:
            continue
        chained, bridges = _compress(low, scratch)
        steps.append(chained)
        beside = F.explode(F.array(*[F.struct(F.least("a", c).alias("e_u"), F.greatest("a", c).alias("e_v")) for c in "xy"]))
        edges, left = _without(edges, low.where(F.col("n") == 2).select(beside.alias("e")).select("e.*"), bridges, first, scratch)
    if not steps:
        return first.select(F.col("u").alias("member"), F.col("v").alias("group_id"))
    parents = steps[0]
    for step in steps[1:]:
        parents = parents.unionByName(step)
    return _labels(scratch.write(parents), scratch)


def _without(edges: DataFrame, gone: DataFrame, new: DataFrame | None, first: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    left = edges.join(gone, (F.col("u") == F.col("e_u")) & (F.col("v") == F.col("e_v")), "left_anti")
    out, told = scratch.measured(left if new is None else left.unionByName(new).distinct(), rows=F.count("*"))
    if edges is not first:
        scratch.drop(edges)
    return out, told["rows"]


def _labels(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """Pointer jumping over the forest of parents, then the least member of each root's group."""
    forest = parents.select("v", F.col("parent").alias("root"))
    while True:
        above = forest.select(F.col("v").alias("k"), F.col("root").alias("above"))
        jumped = forest.join(above, F.col("root") == F.col("k"), "left").select("v", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        jumped, told = scratch.measured(jumped, moved=F.count_if("moved"))
        scratch.drop(forest)
        forest = jumped.select("v", "root")
        if not told["moved"]:
            break
    least = forest.groupBy("root").agg(F.min("v").alias("m")).select(F.col("root").alias("k"), F.least("root", "m").alias("group_id"))
    members = forest.select("root", F.col("v").alias("member")).unionByName(least.select(F.col("k").alias("root"), F.col("k").alias("member")))
    return members.join(least, F.col("root") == F.col("k")).select("member", "group_id")
