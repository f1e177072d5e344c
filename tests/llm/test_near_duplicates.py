import itertools
import random

import numpy as np

from lodemill.llm.near_duplicates import NearDuplicates, band_keys, bands_for, long_signature, signatures
from lodemill.llm.words import words


def jaccard(a, b, k=3):
    s, t = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (words(a), words(b)))
    return len(s & t) / len(s | t)


def collection(rng):
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for n in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(8, 60))]
        for m in range(rng.randrange(1, 6)):
            text = list(base)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((rng.choice(["chunk", "file"]), f"{n}-{m}", rng.choice([" ", "  ", ", "]).join(text)))
    return rows


def brute(rows, least=0.6):
    rows = [r for r in dict.fromkeys(rows) if r[1] and r[2] and len(words(r[2])) >= 8]
    return {(a[0], *sorted((a[1], b[1]))) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and a[1] != b[1] and jaccard(a[2], b[2]) >= least}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "kind string, id string, text string, no int, cls string")


def test_pairs_and_groups_against_brute_force(spark):
    rows = collection(random.Random(5))
    rows += rows[:7] + [("chunk", "null", None), ("chunk", None, rows[0][2]), ("chunk", "empty", ""), ("file", "short", "one two three")]
    near = NearDuplicates(frame(spark, rows), shingle=3, least=0.6)
    found = [tuple(r) for r in near.found_pairs().collect()]
    want = brute(rows)
    assert len(found) == len(set(found)) and set(found) == want
    groups = {(r.kind, r.id): r.group_id for r in near.groups().collect()}
    up = {k: k for k in groups}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for kind, a, b in want:
        x, y = sorted((root((kind, a)), root((kind, b))))
        up[y] = x
    assert groups == {k: root(k)[1] for k in groups}
    assert "short" not in {k[1] for k in groups}


def test_many_copies_are_linked_to_the_least(spark):
    text = " ".join(f"word{i}" for i in range(20))
    rows = [("chunk", f"c{i:03d}", text if i % 2 else text.upper()) for i in range(40)] + [("chunk", "z", text + " more")]
    found = {tuple(r)[1:] for r in NearDuplicates(frame(spark, rows), shingle=3, least=0.6).found_pairs().collect()}
    assert all(("c000", f"c{i:03d}") in found for i in range(1, 40))
    assert ("c000", "z") in found and len(found) < 100


def test_empty_and_very_long(spark):
    assert NearDuplicates(frame(spark, [])).found_pairs().count() == 0
    assert NearDuplicates(frame(spark, [])).groups().count() == 0
    text = " ".join(f"t{i % 9973}" for i in range(60000))
    found = NearDuplicates(frame(spark, [("file", "a", text), ("file", "b", "x " + text)])).found_pairs().collect()
    assert [tuple(r) for r in found] == [("file", "a", "b")]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**63, 300, dtype=np.uint64), rng.integers(0, 2**63, 100, dtype=np.uint64)
    sets = [a, np.concatenate([a[100:], b])]  # 200 of 400 in common
    owner = np.repeat([0, 1], [300, 300])
    sig = signatures(np.concatenate(sets), owner, 2, 256)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.1
    assert band_keys(sig, 4).shape == (2, 64)
    small = signatures(np.array([5], dtype=np.uint64), np.array([0]), 2, 16)
    assert sorted(small[0] >> np.uint64(56)) == list(range(16)) and (small[1] == 2**64 - 1).all()


def test_a_pair_at_the_threshold_is_hardly_ever_missed():
    assert bands_for(0.6) == (30, 3) and bands_for(1.0) == (1, 12)
    for least in (0.2, 0.3, 0.4, 0.5, 0.7, 0.8, 0.9, 0.95):
        bands, rows = bands_for(least)
        assert (1 - least**rows) ** bands < 0.001 and (bands * rows <= 120 or rows == 1)


def test_a_low_threshold_finds_all(spark):
    rows = collection(random.Random(9))
    assert {tuple(r) for r in NearDuplicates(frame(spark, rows), shingle=3, least=0.3).found_pairs().collect()} == brute(rows, 0.3)


def test_signature_of_parts():
    elements = np.random.default_rng(3).integers(0, 2**63, 50_000, dtype=np.uint64)
    assert (long_signature(elements, 90) == signatures(elements, np.zeros(len(elements), np.int64), 1, 90)).all()


def test_groups_of_a_busy_template(spark):
    """Near copies of a template, some too far from it but near another copy: the groups are those of all pairs."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for n in range(150):
        text = list(base)
        for k in rng.sample(range(40), rng.choice([0, 1, 1, 2, 3, 5])):
            text[k] = f"x{rng.randrange(500)}"
        rows.append(("chunk", f"{n:03d}", " ".join(text)))
    near = NearDuplicates(frame(spark, rows), shingle=3, least=0.6)
    group = {r.id: r.group_id for r in near.groups().collect()}
    up = {r[1]: r[1] for r in rows}
    for _ in range(20):
        for _, a, b in brute(rows):
            up[a] = up[b] = min(up[a], up[b])
    assert group == up and len(set(group.values())) > 1


def test_batches_of_which_nothing_is_left(spark):
    """A batch of short texts alone, and one whose last text that is long enough fills what is signed at once."""
    short = [("file", f"s{n}", "one two three") for n in range(3)]
    assert NearDuplicates(frame(spark, short).coalesce(1)).found_pairs().count() == 0
    assert NearDuplicates(frame(spark, short).coalesce(1)).groups().count() == 0
    text = " ".join(f"t{i}" for i in range(25000))
    found = NearDuplicates(frame(spark, [("file", "a", text), ("file", "b", "x " + text), *short]).coalesce(1)).found_pairs().collect()
    assert [tuple(r) for r in found] == [("file", "a", "b")]
