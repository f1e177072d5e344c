import random
from fractions import Fraction

import pytest

from lodemill.llm.mixing import mix, one_period, phases, plan_mix, reached_shares, whole_weights, with_tokens

TARGETS = "source string, target_share double, max_repeats int"


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world, hello!", 3), (2, None, 3), (3, "", 3), (4, "漢字 " * 3000, 3)], "doc_id int, text string, tokens int")
    got = {r.doc_id: r.tokens for r in with_tokens(df).collect()}
    assert got[1] == 5 and got[2] == got[3] == 0 and got[4] > 3000


@pytest.mark.parametrize("shares", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1.0}, {"a": 1.0, "b": 1.0, "c": 1.0, "d": 0.0}, {"a": 0.901, "b": 0.05, "c": 0.049}, {"a": 0.6, "b": 0.3992, "c": 0.0004, "d": 0.0004}])
def test_less_than_one_block_off(shares):
    weights = whole_weights(shares)
    period = sum(weights.values())
    total = sum(shares.values())
    assert all(abs(n / period - shares[s] / total) < 1e-12 for s, n in weights.items())
    done = dict.fromkeys(weights, 0)
    for t, s in enumerate(one_period(weights), 1):
        done[s] += 1
        assert all(abs(done[x] - Fraction(n * t, period)) < 1 for x, n in weights.items())
    assert done == weights


def test_no_share_is_too_small():
    weights = whole_weights({"a": 0.7123456789, "b": 0.2876543210, "c": 1e-9, "d": 0.0}, 1000)
    assert weights == {"a": 712, "b": 288, "c": 1, "d": 0}
    assert whole_weights({}) == {} and whole_weights({"a": 0.0}) == {"a": 0}


def test_phases_fill_every_slot_once():
    weights, blocks = {"a": 5, "b": 3, "c": 2, "e": 1}, {"a": 40, "b": 31, "c": 3, "d": 0, "e": 9}
    placed = phases(weights, blocks)
    assert set(placed) == {"a", "b", "c", "e"}
    slots = {}
    for s, mine in placed.items():
        for k in range(blocks[s]):
            first, start, period, own = max((p for p in mine if p[0] <= k), key=lambda p: p[0])
            slot = start + (k - first) // len(own) * period + own[(k - first) % len(own)]
            assert slot not in slots
            slots[slot] = s
    assert sorted(slots) == list(range(sum(blocks.values())))
    first = max(t for t, s in slots.items() if s == "c")  # until then all sources have their weights
    done = dict.fromkeys(weights, 0)
    for t in range(first + 1):
        done[slots[t]] += 1
        assert all(abs(done[x] - Fraction(n * (t + 1), 11)) < 1 for x, n in weights.items())


def test_small_source_takes_part(spark):
    docs = spark.createDataFrame([(k, "big" if k % 50 else "tiny", 10) for k in range(5000)], "doc_id int, source string, tokens bigint")
    mixed, plan = mix(docs, spark.createDataFrame([("big", 0.9999, 1), ("tiny", 0.0001, 1)], TARGETS), block_tokens=5)
    assert {r.source: (r.tokens, r.short) for r in reached_shares(mixed, plan).collect()} == {"big": (49000, True), "tiny": (10, False)}


def test_mix_against_sequential_filling(spark):
    rng = random.Random(4)
    docs = [(k, rng.choice(["A", " a", "b", "B ", "c", "other", None]), rng.randrange(0, 90)) for k in range(600)]
    docs_df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id int, source string, tokens bigint, slot string")
    targets = spark.createDataFrame([("a", 0.5, 3), ("B", 0.3, 2), ("c ", 0.15, 0), ("none", 0.05, 4), (None, 0.1, 1)], TARGETS)
    mixed, plan = mix(docs_df, targets, block_tokens=100, most_period=20, bucket_docs=20)
    rows = mixed.collect()
    total = sum(d[2] for d in docs)
    by = {r["source"]: r for r in plan}
    assert set(by) == {"a", "b", "c", "none"}
    for s in by:
        own = {d[0]: d[2] for d in docs if d[1] and d[1].strip().lower() == s and d[2]}
        assert by[s]["capacity"] == sum(own.values()) * by[s]["max_repeats"]
        mine = sorted((r for r in rows if r.source == s), key=lambda r: r.start)
        at = 0
        for r in mine:  # copies follow each other without gaps
            assert r.start == at and own[r.doc_id] == r.tokens
            at += r.tokens
        assert at >= by[s]["quota"] and at - by[s]["quota"] < 90 or at == by[s]["capacity"]
        assert len({(r.doc_id, r.copy) for r in mine}) == len(mine) and all(r.copy < by[s]["max_repeats"] for r in mine)
        slots = [r.slot for r in mine]
        assert slots == sorted(slots)
    shares = {r.source: r for r in reached_shares(mixed, plan).collect()}
    assert all(shares[s].short == (by[s]["capacity"] < by[s]["target_share"] * total) for s in by)
    assert abs(sum(r.share for r in shares.values()) - 1) < 1e-9
    assert shares["c"].tokens == shares["none"].tokens == 0 and shares["c"].short and shares["none"].short


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id int, source string, tokens bigint")
    some = spark.createDataFrame([("a", 1.0, 1), ("b", None, None)], TARGETS)
    mixed, plan = mix(none, some)
    assert mixed.count() == 0 and not any(r.short for r in reached_shares(mixed, plan).collect())
    assert reached_shares(mixed, plan).count() == 2
    assert plan_mix(none, some.limit(0)) == []
    mixed, plan = mix(spark.createDataFrame([(1, "a", 5)], none.schema), some.limit(0))
    assert mixed.count() == 0 and reached_shares(mixed, plan).count() == 0
