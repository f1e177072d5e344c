import datetime as dt
import random

import pytest

from lodemill.operators.changefeed import STATUS_OF_KIND, apply_changes, event_schema, resource_schema

T0 = dt.datetime(2025, 1, 1)


def event(seq, kind, rid, detail=None, ws="w", eid=None):
    return (eid or f"e{ws}{seq}", ws, seq, kind, T0, rid, None, detail, T0)


def base(rid, path, status, last, ws="w"):
    return (rid, ws, path, status, 1, T0, T0, last)


def run(spark, resources, events, bits=12):
    out = apply_changes(spark.createDataFrame(resources, resource_schema()), spark.createDataFrame(events, event_schema()), bits)
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r[1:] for r in rows}


def brute(resources, events):
    state = {}
    for r in sorted(resources, key=lambda r: -1 if r[7] is None else r[7]):
        if r[0] is not None:
            state[r[0]] = (r[3], r[2], -1 if r[7] is None else r[7])
    once = {(e[1], e[2], e[5]): e for e in events if e[5] is not None and e[2] is not None and e[3] in STATUS_OF_KIND}
    for e in sorted(once.values(), key=lambda e: e[2]):
        status, path, last = state.get(e[5], (None, None, -1))
        if e[2] > last:
            new = None if e[3] == "resource_deleted" else ((e[7] or {}).get("path") or path)
            state[e[5]] = (STATUS_OF_KIND[e[3]], new, last)
    return {k: v[:2] for k, v in state.items()}


@pytest.mark.parametrize("bits", [0, 2, 12])
def test_random_feeds(spark, bits):
    rng = random.Random(bits)
    resources, events = [], []
    for n in range(12):
        ws = f"w{n % 3}"
        for _ in range(rng.randrange(3)):
            last = rng.randrange(40)
            resources.append(base(f"r{n}", rng.choice([None, f"b{last}"]), rng.choice(["current", "deleted"]), last, ws))
    resources = list({(r[0], r[7]): r for r in resources}.values())
    for w in range(3):
        for seq in range(1, 80):
            if rng.random() < 0.8:
                rid = rng.choice([f"r{n}" for n in range(12) if n % 3 == w] + [None])
                detail = rng.choice([None, {}, {"path": ""}, {"path": f"p{seq}"}])
                events.append(event(seq, rng.choice([*STATUS_OF_KIND, "workspace_registered"]), rid, detail, f"w{w}"))
    events += [(f"again{i}", *e[1:]) for i, e in enumerate(events) if rng.random() < 0.3]
    rng.shuffle(events)
    assert run(spark, resources, events, bits) == brute(resources, events)


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [base("r", "a", "current", 3)], []) == {"r": ("current", "a")}
    assert run(spark, [], [event(1, "resource_created", "r", {"path": "x"})]) == {"r": ("current", "x")}


def test_nulls_and_clashing_columns(spark):
    resources = spark.createDataFrame([base(None, "a", "current", 1), base("r", "a", None, None)], resource_schema())
    events = spark.createDataFrame([event(None, "resource_deleted", "r"), event(2, None, "r"), event(3, "resource_moved", "r", {"path": "é" * 9000})], event_schema())
    from pyspark.sql import functions as F

    out = apply_changes(resources.withColumn("at", F.lit(1)).withColumn("block", F.lit(2)), events.withColumn("path", F.lit("no")).withColumn("sign", F.lit(0)))
    assert [tuple(r) for r in out.collect()] == [("r", "current", "é" * 9000)]


def test_feed_below_the_base_changes_nothing(spark):
    events = [event(s, "resource_moved", "r", {"path": f"p{s}"}) for s in range(1, 6)]
    assert run(spark, [base("r", None, "deleted", 5), base("r", "old", "current", 2)], events, 1) == {"r": ("deleted", None)}
