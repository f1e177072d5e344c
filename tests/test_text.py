import fnmatch
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodemill.functions import text as t
from lodemill.operators import chunking


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("x"))
    return [r.x for r in df.orderBy("i").collect()]


def test_tokens(spark):
    assert column(spark, ["", "hello", "x" * 100, "hello world", "  hello  ", " ", None, "é　" * 9], t.estimate_tokens) == [0, 1, 33, 3, 1, 1, 0, 3]
    assert column(spark, ["", "abcdefgh", None], t.chunk_cost) == [1, 2, 1]
    assert column(spark, ["", "abcde", None], t.preview_cost) == [0, 2, None]


def test_previews(spark):
    assert column(spark, ["a \n b", "abcdef gh", None, ""], lambda c: t.bounded_preview(c, 8)) == ["a b", "abcdef…", None, ""]


def test_redaction(spark):
    got = column(spark, ["API_KEY: abcdefgh12", "password=short", "Bearer abcdefghij x", "token: a$b\\cdefgh", None], t.redact_secrets)
    assert got == ["API_KEY: ***REDACTED***", "password=short", "Bearer ***REDACTED*** x", "token: ***REDACTED***", None]


def test_json_bytes(spark):
    values = ['{"k":"ab"}', '{"b":1,"a":1}', "{}", '"é漢😀\x7f"', '"' + "ü" * 5000 + '"']
    assert column(spark, values, t.json_bytes) == [len(json.dumps(json.loads(v), separators=(",", ":")).encode()) for v in values[:4]] + [30002]


def test_code_fence(spark):
    assert column(spark, ["```json\n{}\n```", " {} ", "```\na\n```"], t.strip_code_fence) == ["{}", "{}", "a"]


def test_words_and_scores(spark):
    assert column(spark, ["hello, world!", "", "  a  .  ", None], t.word_list) == [["hello", "world"], [], ["a", ""], None]
    pairs = spark.createDataFrame([("abc", "xyz"), ("kitten", "sitting"), ("", ""), ("test", "")], "a string, b string")
    assert [round(r[0], 4) for r in pairs.select(t.character_error_rate(F.col("a"), F.col("b"))).collect()] == [1.0, 0.4286, 0.0, 1.0]
    words = spark.createDataFrame([("hello world test", "hello moon test"), ("", ""), ("a", "")], "a string, b string").select(t.word_list(F.col("a")).alias("a"), t.word_list(F.col("b")).alias("b"))
    assert [tuple(round(x, 4) for x in r) for r in words.select(t.positional_accuracy(F.col("a"), F.col("b")), t.token_f1(F.col("a"), F.col("b"))).collect()] == [(0.6667, 0.6667), (1.0, 1.0), (0.0, 0.0)]


def test_globs(spark):
    patterns = ["**/*.md", "a?c", "*.[ch]", "[!x]*.py", "/r/**", "we(ird).t+t"]
    paths = ["/x/y.md", "y.md", "abc", "/q/abc", "m.c", "/d/m.h", "x.py", "/z/y.py", "/r/s/t", "we(ird).t+t", "weird.tt", "C:\\a\\b.md"]
    for pattern in patterns:
        want = [fnmatch.fnmatchcase(p.replace("\\", "/"), pattern) or fnmatch.fnmatchcase(p.replace("\\", "/").split("/")[-1], pattern) for p in paths]
        assert column(spark, paths, lambda c, pattern=pattern: t.matches_any(c, [pattern])) == want, pattern
    assert column(spark, ["/a/b", "/a", "/ab", "/a/"], lambda c: t.is_within(c, F.lit("/a/"))) == [True, True, False, True]


@given(st.text(alphabet="ab .\n", max_size=300), st.integers(2, 30))
@settings(max_examples=200, deadline=None)
def test_pieces_lose_nothing_and_keep_the_bound(text, target):
    parts = chunking.pieces(text, target)
    assert "".join("".join(parts).split()).replace(".", "") == "".join(text.split()).replace(".", "")
    assert all(chunking.tokens(p) <= target for p in parts)


def test_chunks(spark):
    paragraphs = "\n\n".join("word " * 60 for _ in range(10))
    df = spark.createDataFrame([("a", paragraphs), ("b", "short"), ("c", "  "), ("d", None), ("e", "a" * 10_000)], "id string, text string")
    out = {}
    for r in chunking.chunked(df, 128, 16).orderBy("id", "ordinal").collect():
        out.setdefault(r.id, []).append(r.text)
    assert set(out) == {"a", "b", "e"} and out["b"] == ["short"]
    assert len(out["a"]) >= 2 and sum(map(len, out["e"])) >= 10_000
    assert chunking.with_overlap(["abc d", "ef"], 2) == ["abc d", "c def"]
    assert chunking.chunked(df.limit(0)).count() == 0
    assert pytest.approx(chunking.tokens("x" * 100)) == 33
