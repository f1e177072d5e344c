import random

import numpy as np

from lodemill.llm.leakage import WINDOW, ItemIndex, find_leaks, fingerprints, item_size, weighted_similarity
from lodemill.llm.words import word_hashes, words


def brute(docs, items, n=12):
    def runs(text):
        w = words(text)
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    return {(d, i) for d, t in docs for i, u in items if d is not None and i is not None and runs(t) & runs(u)}


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, windows int")
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, similarity int")
    return find_leaks(d, i, **options).collect()


def test_against_brute_force(spark):
    rng = random.Random(2)
    words_ = [f"w{k}" for k in range(300)]
    text = lambda n: [rng.choice(words_) for _ in range(n)]
    items = [(k, " ".join(text(rng.randrange(5, 60)))) for k in range(40)]
    docs = []
    for k in range(120):
        parts = text(rng.randrange(0, 50))
        for _ in range(rng.randrange(3)):
            w = items[rng.randrange(40)][1].split()
            a = rng.randrange(len(w))
            parts += w[a : a + rng.randrange(8, 25)]
        docs.append((k, " ".join(parts + text(5))))
    docs += docs[:3] + [(900, None), (901, ""), (None, items[0][1]), (902, items[7][1].upper().replace(" ", "\n- "))]
    items += items[:2] + [(900, None), (901, ""), (None, docs[5][1])]
    want = brute(docs, items)
    rows = run(spark, docs, items)
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})
    assert {(r.doc_id, r.item_id) for r in rows if r.exact} == want
    assert {(r.doc_id, r.item_id) for r in run(spark, docs, items, block_words=100) if r.exact} == want


def test_empty(spark):
    assert run(spark, [], [(1, "x " * 20)]) == []
    assert run(spark, [(1, "x " * 20)], []) == []


def test_very_long_text(spark):
    item = " ".join(f"i{k}" for k in range(30))
    filler = " ".join(f"f{k % 4999}" for k in range(90000))
    rows = run(spark, [(1, filler + " " + item + " " + filler)], [(5, item)])
    assert [(r.doc_id, r.item_id, r.exact) for r in rows] == [(1, 5, True)]


def test_blocks_find_all_within_the_radius():
    index = ItemIndex([(k, " ".join(f"a{(k * 31 + j) % 997}" for j in range(40))) for k in range(30)])
    rng = np.random.default_rng(0)
    for known in index.windows.values():
        prints = known.prints.copy()
        for row in range(len(prints)):
            for bit in rng.choice(64, rng.integers(0, 11), replace=False):
                prints[row] ^= np.uint64(1) << np.uint64(bit)
        a, b = known.candidates(prints)
        want = {(i, int(j)) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(prints[i] ^ known.prints) <= 7)}
        assert len(a) == len(set(zip(a, b))) and set(zip(a.tolist(), b.tolist())) == want
    assert len(word_hashes(None)) == 0


def test_fingerprints_by_brute_force():
    rng = np.random.default_rng(1)
    for words_ in (0, 5, 12, 47, 48, 130):
        hashes = rng.integers(0, 1 << 63, words_, dtype=np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(int)
        for size, prints in fingerprints(hashes, [12, 24, 48, 96]).items():
            want = [np.packbits(bits[i : i + size].sum(axis=0) > size // 2).view(np.uint64)[0] for i in range(words_ - size + 1)]
            assert prints.tolist() == [int(x) for x in want]


def test_similarity_counts_repeats():
    a = np.array([[1, 1, 2, 3], [1, 2, 3, 4], [5, 5, 5, 5]], dtype=np.uint64)
    b = np.array([[1, 2, 2, 4], [4, 3, 2, 1], [5, 5, 6, 7]], dtype=np.uint64)
    assert weighted_similarity(a, b).tolist() == [2 / 6, 1.0, 2 / 6]


def test_item_size():
    assert [item_size(n) for n in (0, 12, 29, 30, 60, 67, 119, 120, 5000)] == [WINDOW, 12, 12, 24, 48, 48, 48, 96, 192]


def passages(rng, count, size):
    vocabulary = [f"w{k}" for k in range(3000)]
    return [[rng.choice(vocabulary) for _ in range(size)] for _ in range(count)]


def planted(spark, edit, count=200, size=60):
    """The share of items found in documents that hold them edited, and the links between others."""
    rng = random.Random(8)
    items = passages(rng, count, size)
    docs = []
    for k, words_ in enumerate(items):
        before, after = passages(rng, 2, 80)
        docs.append((k, " ".join(before + edit(list(words_), rng) + after)))
    rows = run(spark, docs, [(k, " ".join(w)) for k, w in enumerate(items)])
    found = {(r.doc_id, r.item_id) for r in rows}
    return sum((k, k) in found for k in range(count)) / count, sum(d != i for d, i in found)


def every(n):
    def edit(words_, rng):
        for k in range(rng.randrange(n), len(words_), n):
            words_[k] = f"x{rng.randrange(9999)}"
        return words_

    return edit


def test_recall_on_edited_passages(spark):
    for n, least in ((15, 0.99), (12, 0.99), (10, 0.97), (8, 0.9)):
        recall, others = planted(spark, every(n))
        assert recall >= least and others == 0, (n, recall, others)


def test_recall_on_dropped_and_added_words(spark):
    def edit(words_, rng):
        return [w for k, w in enumerate(words_) for w in ([] if k % 20 == 7 else [w, "extra"] if k % 20 == 15 else [w])]

    recall, others = planted(spark, edit)
    assert recall >= 0.95 and others == 0


def test_moved_sentences(spark):
    recall, others = planted(spark, lambda words_, rng: [w for low in rng.sample(range(0, 60, 6), 10) for w in words_[low : low + 6]])
    assert recall >= 0.9 and others == 0
