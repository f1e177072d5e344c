import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lodemill.llm.splitting import WHITE_SPACE, cut, split_oversized

SEPARATORS = ["\n\n", "\n", ". ", " ", ""]


def solid(text):
    return sum(c not in WHITE_SPACE for c in text)


def check(text, target, overlap, separators=SEPARATORS):
    pieces = cut(text, target, overlap, separators)
    shared = 3 * min(max(0, overlap), target - 1)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, b in pieces:
        assert solid(text[a:b]) // 3 <= target
    for (_, b), (a, d) in zip(pieces, pieces[1:]):
        assert a <= b < d
        assert solid(text[a:b]) == min(shared, solid(text[:b]))
    return pieces


@given(st.text(alphabet="ab .\n　é", max_size=400), st.integers(1, 20), st.integers(0, 25))
@settings(max_examples=300, deadline=None)
def test_cover_limit_and_overlap(text, target, overlap):
    check(text, target, overlap)


def test_fits():
    assert cut("", 5, 1, SEPARATORS) == [(0, 0)]
    assert cut("a" * 17, 5, 1, SEPARATORS) == [(0, 17)]
    assert len(cut("a" * 18, 5, 1, SEPARATORS)) == 2


def test_strongest_boundary_near_the_target():
    text = "aaaa bbbb. cccc dddd\n\neeee ffff gggg hhhh iiii"
    pieces = check(text, 9, 0)
    assert text[: pieces[0][1]].endswith("\n\n")


def test_least_count_and_balance():
    pieces = check("a" * 3000, 400, 0)
    assert len(pieces) == 3
    assert max(b - a for a, b in pieces) - min(b - a for a, b in pieces) <= 2


def test_long_text():
    rng = random.Random(1)
    text = "".join(rng.choice(["word ", "x. ", "\n\n", "pneumonoultra"]) for _ in range(60000))
    check(text, 256, 32)


def test_operator(spark):
    rows = [("a", "x" * 40, 5, 1, SEPARATORS, 9), ("a", "x" * 40, 5, 1, SEPARATORS, 9), ("b", None, 5, 1, SEPARATORS, 9), ("c", "short", 5, 1, SEPARATORS, 9), ("d", "y" * 40, None, 1, None, 9), ("e", "z " * 40, 5, None, None, 9), (None, "z" * 99, 5, 1, None, 9)]
    df = spark.createDataFrame(rows, "id string, text string, target_tokens int, overlap int, separator_hierarchy array<string>, piece int")
    out = split_oversized(df, "id", "text", "target_tokens", "overlap", "separator_hierarchy").collect()
    assert {r.item_id for r in out} == {"a", "e"}
    assert [r.text for r in sorted(out, key=lambda r: r.piece) if r.item_id == "a"] == ["x" * (b - a) for a, b in cut("x" * 40, 5, 1, SEPARATORS)]
    assert all(r.tokens <= 5 for r in out)
    assert split_oversized(df.limit(0), "id", "text", "target_tokens", "overlap", "separator_hierarchy").count() == 0
