import random

import pytest
from pyspark.sql import functions as F

from lodemill.functions import text as t
from lodemill.operators import joins


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_as_of(spark, bucket):
    rng = random.Random(bucket)
    left = [(rng.choice("ab"), rng.randrange(60)) for _ in range(60)] + [("c", 5)]
    right = [(rng.choice("ab"), rng.randrange(60), rng.randrange(99)) for _ in range(25)]
    out = joins.as_of(spark.createDataFrame(left, "k string, t long"), spark.createDataFrame(right, "k string, t long, v int"), "k", "t", "v", bucket)
    want = sorted((k, at, max(((rt, v) for rk, rt, v in right if rk == k and rt <= at), default=(None, None))[1] or 0) for k, at in left)
    assert sorted((r.k, r.t, r.v or 0) for r in out.collect()) == want


def test_patterns_and_dependencies(spark):
    asked = spark.createDataFrame([("image/png", "ocr"), ("image/png", "ocr"), ("text/x", "ocr"), (None, "ocr"), ("image/png", "x")], "mime string, kind string")
    registry = [("first", "image/*", "ocr"), ("second", "*", "ocr")]
    assert {tuple(r) for r in joins.resolve_by_pattern(asked, registry).collect()} == {("image/png", "ocr", "first"), ("text/x", "ocr", "second")}
    wanted = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", None), ("e", None)], "id string, expected string")
    state = spark.createDataFrame([("a", "1"), ("b", "2"), ("e", None)], "id string, actual string")
    got = {r.id: r.finding for r in joins.dependency_status(wanted, state).collect()}
    assert got == {"a": "ok", "b": "mismatch", "c": "missing", "d": "ok", "e": "unexpected"}


def test_waves():
    stages = {"decode": set(), "speech": {"decode"}, "speakers": {"decode"}, "merge": {"speech", "speakers"}, "alone": set()}
    assert joins.waves(stages) == [["alone", "decode"], ["speakers", "speech"], ["merge"]]
    assert joins.downstream(stages, "decode") == {"speech", "speakers", "merge"} and joins.downstream(stages, "merge") == set()
    for bad in ({"a": {"b"}, "b": {"a"}}, {"a": {"zzz"}}):
        with pytest.raises(ValueError):
            joins.waves(bad)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first().x


def test_extraction_gate(spark):
    good = '{"summary":"s","entities":[{"name":"Acme","kind":"org"}],"topics":["t"],"references":[]}'
    assert one(spark, good, t.gated_extraction).entities[0].name == "Acme"
    assert one(spark, "```json\n" + good + "\n```", t.gated_extraction) is not None
    import json

    assert one(spark, json.dumps(good), t.gated_extraction) is not None
    for bad in ("", "no json", "{}", good.replace('"summary":"s",', ""), good.replace('"topics"', '"extra":1,"topics"'), good.replace(',"kind":"org"', ""), None):
        assert one(spark, bad, t.gated_extraction) is None


def test_segments(spark):
    good = '[{"start_ms":0,"end_ms":1000,"text":"","kind":"silence"},{"start_ms":1000,"end_ms":3000,"text":"hi","kind":"speech","confidence":0.92}]'
    assert len(one(spark, good, t.parsed_segments)) == 2
    assert one(spark, good.replace('"text":""', '"text":"x"'), t.parsed_segments) is None
    assert one(spark, good.replace('"end_ms":1000', '"end_ms":0'), t.parsed_segments) is None
    assert [one(spark, v, t.is_anonymous_speaker) for v in ("SPEAKER_1", "Bob", "SPEAKER_")] == [True, False, False]


def test_bytes_and_words(spark):
    assert [one(spark, "aé漢", lambda c, n=n: t.truncated_bytes(c, n)) for n in (1, 2, 3, 5, 6)] == ["a", "a", "aé", "aé", "aé漢"]
    pairs = [("hello world", "foo bar", 1.0), ("x", "", 0.0), ("a b c d", "a", 3.0), ("a c", "a b c", 1 / 3), ("", "a b", 1.0)]
    for found, truth, want in pairs:
        df = spark.createDataFrame([(found, truth)], "a string, b string").select(t.word_error_rate(t.word_list(F.col("a")), t.word_list(F.col("b"))).alias("x"))
        assert df.first().x == pytest.approx(want)


def test_prompt(spark):
    row = spark.sql("select array(named_struct('path', '/a', 'summary', null)) f, array(named_struct('id', 'c1', 'text', 'words')) c, cast(array() as array<string>) r")
    got = row.select(t.rendered_prompt(F.lit("why?"), F.col("f"), F.col("c"), F.col("r"))).first()[0]
    assert got == "Question: why?\n\nFiles:\n- /a: \n\nEvidence (untrusted):\n[c1] words"
