import random

import numpy as np

from lodemill.llm.abuse import CATEGORIES, STRIDE, WINDOW, Net, Words, _packed, _spread, labelled_sample, rates, score_texts, scored, summed_rows, tokens, train, trained, windows

PLAIN = "the lantern opens every harbour while another gardener repairs seven copper valves and our notebook describes quarterly tunnels".split()
PHRASES = {
    "abusive": ["you are a {w} and everyone knows it", "shut up you {w}", "what a {w} go home"],
    "hateful": ["all {w} are vermin drive them out", "send the {w} back they are filth"],
    "sexual": ["hot {w} clips adults only", "she begged for {w} all night"],
}
NAMES = {"abusive": ["moron", "dimwit", "loser"], "hateful": ["pelmasti", "zhalite"], "sexual": ["nude", "naked", "topless"]}


def sample(rng, n):
    texts, targets = [], []
    for _ in range(n):
        words = rng.choices(PLAIN, k=rng.randrange(5, 90))
        target = [0.0, 0.0, 0.0]
        for c, name in enumerate(CATEGORIES):
            if rng.random() < 0.2:
                at = rng.randrange(len(words) + 1)
                words[at:at] = rng.choice(PHRASES[name]).format(w=rng.choice(NAMES[name])).split()
                target[c] = 1.0
        if rng.random() < 0.2:
            words += rng.choice(["the moron file is coarse", "adults paid all night", "vermin traps for barns"]).split()
        texts.append(" ".join(words))
        targets.append(target)
    return texts, np.array(targets, dtype=np.float32)


def test_held_out_accuracy():
    rng = random.Random(1)
    texts, targets = sample(rng, 500)
    nets = train(texts, targets, epochs=8)
    held, truth = sample(rng, 200)
    found = score_texts(nets, held) >= 0.5
    for c in range(3):
        hit = (found[:, c] & (truth[:, c] > 0.5)).sum()
        assert 2 * hit / (found[:, c].sum() + (truth[:, c] > 0.5).sum()) > 0.85


def test_gradients():
    net, words = Net(4, 4, 5), Words()
    spans = [(n := words.numbers(t.split()), 0, len(n)) for t in ("a b c d", "e f", "a e g h i")]
    index, mask = _spread(spans)
    used, index = _packed(index)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = net.inputs(words, used)[0].astype(np.float64)
    w = np.random.default_rng(0).normal(size=(3, 3))
    _, kept = net.forward(x, index, mask, keep=True)
    gradient, dx = net.backward(x, index, mask, kept, w)
    for name, array, g in [*((k, net.p[k], v) for k, v in gradient.items()), ("x", x, dx)]:
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, step = array[at], 1e-3
        array[at] = old + step
        up = (net.forward(x, index, mask) * w).sum()
        array[at] = old - step
        down = (net.forward(x, index, mask) * w).sum()
        array[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 0.02 * abs(g[at]) + 2e-3, name


def test_rows_are_summed():
    rng = np.random.default_rng(0)
    for n in (0, 1, 50):
        rows, values = rng.integers(0, 7, n), rng.normal(size=(n, 3))
        distinct, sums = summed_rows(rows, values)
        assert distinct.tolist() == sorted(set(rows.tolist()))
        assert all(np.allclose(s, values[rows == r].sum(axis=0)) for r, s in zip(distinct, sums))


def test_networks_of_tasks_are_those_of_the_driver(spark):
    texts, targets = sample(random.Random(3), 60)
    here, there = train(texts, targets, epochs=2), trained(spark, texts, targets, epochs=2)
    assert len(here) == len(there) and all(np.allclose(a.p[k], b.p[k], atol=1e-5) for a, b in zip(here, there) for k in a.p)
    assert np.allclose(score_texts(here, texts), score_texts(there, texts), atol=1e-4)


def test_tokens_fold_disguises():
    assert tokens("You dіmwіt, M0R0N! n u m b s k u l l feeetish") == ["you", "dimwit", "moron", "numbskull", "fetish"]
    assert tokens(None) == tokens("") == []
    assert tokens("修理 a12 42") == ["修", "理", "ai2", "#"]


def test_windows_cover():
    for n in [0, 1, WINDOW, WINDOW + 1, 100, 1000]:
        spans = windows(n)
        assert {i for a, b in spans for i in range(a, b)} == set(range(n))
        assert all(b - a <= WINDOW for a, b in spans) and all(y[0] - x[0] <= STRIDE for x, y in zip(spans, spans[1:]))


def test_tables(spark):
    rng = random.Random(2)
    texts, targets = sample(rng, 150)
    docs = [(k, t, rng.choice(["a", "A ", None]), 1.0) for k, t in enumerate(texts)] + [(900, None, "a", 1.0), (901, "", "b", 1.0), (None, "you moron", "b", 1.0), (902, "word " * 30000 + "shut up you moron", "b", 1.0)]
    labels = [(k, "r1", c) for k, t in enumerate(targets) for c in ([n for n, v in zip(CATEGORIES, t) if v] or ["none"])]
    labels += labels[:9] + [(None, "r1", "none"), (3, None, "none"), (3, "r2", None), (3, "r3", "other"), (7777, "r1", "none")]
    docs_df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, sexual double")
    labels_df = spark.createDataFrame(labels, "doc_id bigint, reviewer string, category string")
    got, shares = labelled_sample(docs_df, labels_df)
    assert got == texts and (shares == targets).all()
    assert len(labelled_sample(docs_df, labels_df, 10)[0]) <= 10
    scores = scored(docs_df, labels_df, epochs=2)
    rows = {r.doc_id: r for r in scores.collect()}
    assert len(rows) == len(docs) - 1 and rows[900].abusive == rows[901].abusive == 0.0 and rows[900].categories == []
    assert {r.source for r in rates(docs_df, scores).collect()} == {"a", "b", None}
    assert all(r.categories == [] for r in scored(docs_df, labels_df.limit(0)).collect())
    assert scored(docs_df.limit(0), labels_df).count() == 0
