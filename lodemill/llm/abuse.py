"""Abusive, hateful or sexual content: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters by its own embedding and by those of its character trigrams, after look-alike characters, digits for
letters and spaced-out words are folded, so that disguised words come near the plain ones. The network scores windows
of words that overlap by half and cover a whole text; a text's score is that of its highest window. It is trained on
labelled texts, where only the window that scores highest for a label stands for it.

Training uses a bounded sample of labelled documents (``most_labelled``); every document is scored in full.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The categories of the labels.
CATEGORIES = ("abusive", "hateful", "sexual")

# Letters of other scripts and signs that stand for Latin letters.
_ALIKE = str.maketrans("аеорсухіјѕԁһӏкмтвнгαοερτυικν", "aeopcyxijsdhlkmtbhraoeptuikv")
_LEET = str.maketrans("0134578@$!|", "oieastbasil")

WINDOW, STRIDE = 24, 12
SEEDS = (3, 5)
WORD_ROWS, CHAR_ROWS = 1 << 15, 1 << 13
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿가-힯]|[^\W_](?:[^\s,.;:?()\[\]<>\"“”/=_-]*[^\W_])?")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .*_-][^\W\d_]){2,}(?![^\W_])")
_LONG = re.compile(r"(.)\1{2,}")
_HIDDEN = re.compile("[­​-‏⁠﻿]")


def tokens(text: str | None) -> list[str]:
    """Words in small letters, folded; each CJK character is a word; digits alone are ``#``."""
    if not text:
        return []
    text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text).lower()).translate(_ALIKE)
    text = _SPACED.sub(lambda m: re.sub(r"[ .*_-]", "", m[0]), text)
    out = []
    for t in _TOKEN.findall(text):
        if t.isdigit():
            t = "#"
        elif not t.isalpha() and any(c.isalpha() for c in t):
            t = t.translate(_LEET)
        out.append(_LONG.sub(r"\1", t))
    return out


def windows(count: int) -> list[tuple[int, int]]:
    """(start, end) of windows that cover ``count`` words; none for none."""
    if count <= WINDOW:
        return [(0, count)] if count else []
    starts = list(range(0, count - WINDOW, STRIDE)) + [count - WINDOW]
    return [(s, s + WINDOW) for s in starts]


class Words:
    """Distinct words by number, with their rows in the two embedding tables."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.word_row: list[int] = []
        self.char_rows: list[list[int]] = []

    def numbers(self, found: list[str]) -> list[int]:
        out = []
        for w in found:
            k = self.number.get(w)
            if k is None:
                k = self.number[w] = len(self.word_row)
                self.word_row.append(xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) % WORD_ROWS)
                marked = f"^{w}$"
                self.char_rows.append([xxhash.xxh32_intdigest(marked[i : i + 3].encode("utf-8", "surrogatepass"), 7) % CHAR_ROWS for i in range(max(1, len(marked) - 2))])
            out.append(k)
        return out


class Net:
    """Parameters by name. Two GRUs run over the words' inputs, forward and backward; attention pools their states."""

    def __init__(self, word: int = 16, char: int = 24, hidden: int = 24, seed: int = 11):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.sizes = (word, char, hidden)
        d = word + char
        self.p = {"word": 0.1 * rng.normal(size=(WORD_ROWS, word)).astype(np.float32), "char": 0.3 * rng.normal(size=(CHAR_ROWS, char)).astype(np.float32)}
        for way in "fb":
            self.p |= {f"W{way}": normal(d, 3 * hidden), f"U{way}": normal(hidden, 3 * hidden), f"b{way}": np.zeros(3 * hidden, np.float32)}
        self.p |= {"A": normal(2 * hidden, hidden), "a": np.zeros(hidden, np.float32), "v": normal(hidden, 1)[:, 0], "C": normal(2 * hidden, len(CATEGORIES)), "c": np.full(len(CATEGORIES), -2.0, np.float32)}

    def inputs(self, vocabulary: Words, used: np.ndarray) -> tuple[np.ndarray, tuple]:
        rows = np.array([vocabulary.word_row[k] for k in used], dtype=np.int64)
        lists = [vocabulary.char_rows[k] for k in used]
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        flat = np.fromiter((r for x in lists for r in x), dtype=np.int64, count=int(sizes.sum()))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        chars = np.add.reduceat(self.p["char"][flat], starts, axis=0) / np.sqrt(sizes)[:, None].astype(np.float32) if len(used) else np.zeros((0, self.sizes[1]), np.float32)
        return np.concatenate([self.p["word"][rows], chars], axis=1).astype(np.float32), (rows, flat, sizes)

    def forward(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. ``x``: inputs of distinct words; ``index``: (windows, places) rows of x; ``mask``: which places hold words."""
        if not keep:
            return self.logits(self.projected(x), index, mask)
        count, length = index.shape
        hidden = self.sizes[2]
        states = np.empty((length, count, 2 * hidden), np.float32)
        kept: dict = {}
        for way, order in (("f", range(length)), ("b", range(length - 1, -1, -1))):
            projected = x @ self.p[f"W{way}"] + self.p[f"b{way}"]
            U = self.p[f"U{way}"]
            h = np.zeros((count, hidden), np.float32)
            steps = []
            side = slice(0, hidden) if way == "f" else slice(hidden, None)
            for t in order:
                gates, rec = projected[index[:, t]], h @ U
                zr = 1 / (1 + np.exp(-(gates[:, : 2 * hidden] + rec[:, : 2 * hidden])))
                z, r = zr[:, :hidden], zr[:, hidden:]
                n = np.tanh(gates[:, 2 * hidden :] + r * rec[:, 2 * hidden :])
                m = mask[:, t : t + 1]
                after = h + m * (1 - z) * (n - h)
                steps.append((t, h, z, r, n, rec[:, 2 * hidden :]))
                h = after
                states[t, :, side] = h
            kept[way] = steps
        u = np.tanh(states @ self.p["A"] + self.p["a"])
        score = u @ self.p["v"] + np.where(mask.T > 0, 0, -1e9).astype(np.float32)
        e = np.exp(score - score.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.einsum("tc,tch->ch", alpha, states)
        logits = pooled @ self.p["C"] + self.p["c"]
        return logits, (kept, states, u, alpha, pooled)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """What the gates of either direction see of each input."""
        return np.stack([x @ self.p[f"W{way}"] + self.p[f"b{way}"] for way in "fb"])

    def logits(self, both: np.ndarray, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Logits of windows of projected inputs: both directions at once and in place, without what training needs."""
        count, length = index.shape
        hidden = self.sizes[2]
        U = np.stack([self.p["Uf"], self.p["Ub"]])
        h = np.zeros((2, count, hidden), np.float32)
        states = np.empty((length, count, 2 * hidden), np.float32)
        full = bool(mask.all())
        columns = np.ascontiguousarray(index.T)
        rec, gates = np.empty((2, count, 3 * hidden), np.float32), np.empty((2, count, 3 * hidden), np.float32)
        for step in range(length):
            places = (step, length - 1 - step)
            for way, t in enumerate(places):
                np.take(both[way], columns[t], axis=0, out=gates[way], mode="clip")
            np.matmul(h, U, out=rec)
            zr, n = gates[:, :, : 2 * hidden], gates[:, :, 2 * hidden :]
            zr += rec[:, :, : 2 * hidden]
            zr *= 0.5  # a logistic function is a tanh of half its argument
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            candidate = rec[:, :, 2 * hidden :]
            candidate *= zr[:, :, hidden:]
            n += candidate
            np.tanh(n, out=n)
            n -= h
            n *= 1 - zr[:, :, :hidden]
            if not full:
                n *= np.stack([mask[:, t] for t in places])[:, :, None]
            h += n
            for way, t in enumerate(places):
                states[t, :, way * hidden : (way + 1) * hidden] = h[way]
        u = states @ self.p["A"]
        u += self.p["a"]
        np.tanh(u, out=u)
        score = u @ self.p["v"]
        if not full:
            score += np.where(mask.T > 0, 0, -1e9).astype(np.float32)
        score -= score.max(axis=0)
        np.exp(score, out=score)
        score /= score.sum(axis=0)
        return np.einsum("tc,tch->ch", score, states) @ self.p["C"] + self.p["c"]

    def backward(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, kept: tuple, dlogits: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters but the embeddings, and of ``x``."""
        steps, states, u, alpha, pooled = kept
        hidden = self.sizes[2]
        g = {"C": pooled.T @ dlogits, "c": dlogits.sum(axis=0)}
        dpooled = dlogits @ self.p["C"].T
        dalpha = np.einsum("ch,tch->tc", dpooled, states)
        dscore = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        g["v"] = np.einsum("tc,tch->h", dscore, u)
        du = dscore[:, :, None] * self.p["v"] * (1 - u * u)
        g["A"] = np.einsum("tci,tcj->ij", states, du)
        g["a"] = du.sum(axis=(0, 1))
        dstates = alpha[:, :, None] * dpooled + du @ self.p["A"].T
        dx = np.zeros_like(x)
        for way in "fb":
            U = self.p[f"U{way}"]
            side = slice(0, hidden) if way == "f" else slice(hidden, None)
            dproj = np.zeros((len(x), 3 * hidden), np.float32)
            dsteps = np.empty((index.shape[1], index.shape[0], 3 * hidden), np.float32)
            dU = np.zeros_like(U)
            dh = np.zeros((index.shape[0], hidden), np.float32)
            for t, h, z, r, n, rec in reversed(steps[way]):
                dh = dh + dstates[t, :, side]
                m = mask[:, t : t + 1]
                dn = dh * m * (1 - z) * (1 - n * n)
                dz = dh * m * (h - n) * z * (1 - z)
                dr = dn * rec * r * (1 - r)
                dsteps[t] = np.concatenate([dz, dr, dn], axis=1)
                drec = np.concatenate([dz, dr, dn * r], axis=1)
                dU += h.T @ drec
                dh = dh * (1 - m * (1 - z)) + drec @ U.T
            met, sums = summed_rows(index.T.ravel(), dsteps.reshape(-1, 3 * hidden))
            dproj[met] = sums
            g |= {f"U{way}": dU, f"W{way}": x.T @ dproj, f"b{way}": dproj.sum(axis=0)}
            dx += dproj @ self.p[f"W{way}"].T
        return g, dx


def summed_rows(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``rows`` and the sum of the values of each."""
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(rows) else np.empty(0, np.int64)
    return ordered[starts], np.add.reduceat(values[order], starts, axis=0) if len(rows) else values


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _spread(spans: list[tuple[list[int], int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Each window as the numbers of its words, with a mask."""
    sizes = np.array([b - a for _, a, b in spans], dtype=np.int64)
    mask = (np.arange(WINDOW) < sizes[:, None]).astype(np.float32)
    index = np.zeros((len(spans), WINDOW), np.int64)
    index[mask > 0] = np.fromiter((w for words, a, b in spans for w in words[a:b]), dtype=np.int64, count=int(sizes.sum()))
    return index, mask


def _packed(index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of windows, and each window as places among them."""
    used, place = np.unique(index, return_inverse=True)
    return used, place.reshape(index.shape)


def score_windows(nets: list[Net], vocabulary: Words, index: np.ndarray, mask: np.ndarray, batch: int = 256) -> np.ndarray:
    """The mean of the networks' logits of each window of numbered words."""
    out = np.zeros((len(index), len(CATEGORIES)), np.float32)
    every = np.arange(len(vocabulary.word_row))
    for net in nets:
        both = net.projected(net.inputs(vocabulary, every)[0])
        for low in range(0, len(index), batch):
            out[low : low + batch] += net.logits(both, index[low : low + batch], mask[low : low + batch])
    return out / len(nets)


def score_texts(nets: list[Net], texts: list) -> np.ndarray:
    """The highest score of any window of each text by category, by the mean of the networks; zeros for a text without words."""
    vocabulary = Words()
    numbered = [vocabulary.numbers(tokens(t)) for t in texts]
    spans = [(n, a, b) for n in numbered for a, b in windows(len(n))]
    owner = np.repeat(np.arange(len(texts)), [len(windows(len(n))) for n in numbered])
    out = np.zeros((len(texts), len(CATEGORIES)), np.float32)
    for low in range(0, len(spans), 16_384):  # so that a very long text needs no more memory than a batch of others
        np.maximum.at(out, owner[low : low + 16_384], sigmoid(score_windows(nets, vocabulary, *_spread(spans[low : low + 16_384]))))
    return out


class Trainer:
    """Adam on the network's weights, Adagrad on the rows of the embeddings that a batch meets."""

    def __init__(self, net: Net, rate: float = 4e-3, row_rate: float = 0.08):
        self.net, self.rate, self.row_rate, self.step = net, rate, row_rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items() if k not in ("word", "char")}
        self.s = {k: np.zeros_like(v) for k, v in self.m.items()}
        self.rows = {k: np.full(len(net.p[k]), 1e-3, np.float32) for k in ("word", "char")}

    def update(self, vocabulary: Words, index: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray, drop: np.random.Generator) -> float:
        used, index = _packed(index)
        x, (rows, flat, sizes) = self.net.inputs(vocabulary, used)
        word = self.net.sizes[0]
        x[drop.random(len(x)) < 0.3, :word] = 0  # so that spelling and context count as well
        logits, kept = self.net.forward(x, index, mask, keep=True)
        p = sigmoid(logits)
        total = max(1.0, float((weight > 0).any(axis=1).sum()))
        g, dx = self.net.backward(x, index, mask, kept, ((p - target) * weight / total).astype(np.float32))
        self.step += 1
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        scale = min(1.0, 1.0 / (norm + 1e-9))
        for k, v in g.items():
            v = v * scale
            self.m[k] = 0.9 * self.m[k] + 0.1 * v
            self.s[k] = 0.999 * self.s[k] + 0.001 * v * v
            step = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
            self.net.p[k] -= step * self.m[k] / (np.sqrt(self.s[k]) + 1e-8)
        self._rows("word", rows, dx[:, :word])
        self._rows("char", flat, np.repeat(dx[:, word:] / np.sqrt(sizes)[:, None], sizes, axis=0))
        return float(-(weight * (target * np.log(p + 1e-7) + (1 - target) * np.log(1 - p + 1e-7))).sum() / total)

    def _rows(self, name: str, rows: np.ndarray, gradient: np.ndarray) -> None:
        distinct, summed = summed_rows(rows, gradient)
        self.rows[name][distinct] += (summed**2).sum(axis=1)
        self.net.p[name][distinct] -= self.row_rate * summed / np.sqrt(self.rows[name][distinct])[:, None]


def train(texts: list, targets: np.ndarray, epochs: int = 10, batch: int = 128, seeds: tuple[int, ...] = SEEDS) -> list[Net]:
    """Networks that differ in their random start, from texts and the share of reviewers who saw each category in them.

    Shares of one half tell nothing and have no weight. In the first epochs the window of a label is the one whose
    words are most typical of labelled texts, then the one that the network scores highest. What networks learn by
    heart from mistaken labels differs, so their mean is better than each.
    """
    return [fit(texts, targets, seed, epochs, batch) for seed in seeds]


def fit(texts: list, targets: np.ndarray, seed: int, epochs: int = 10, batch: int = 128) -> Net:
    rng = np.random.default_rng(seed)
    net, vocabulary = Net(seed=seed), Words()
    trainer = Trainer(net)
    numbered = [vocabulary.numbers(tokens(t)) for t in texts]
    spans = [(n, a, b) for n in numbered for a, b in windows(len(n))]
    of = [[] for _ in texts]
    for k, d in enumerate(np.repeat(np.arange(len(texts)), [len(windows(len(n))) for n in numbered])):
        of[d].append(k)
    index, mask = _spread(spans)
    typical = _typical(numbered, targets, len(vocabulary.word_row))
    for epoch in range(epochs):
        if epoch < 2:
            scores = np.array([[typical[c][np.unique(n[a:b])].sum() for c in range(len(CATEGORIES))] for n, a, b in spans], dtype=np.float32)
        else:
            scores = score_windows([net], vocabulary, index, mask)
        chosen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d, mine in enumerate(of):
            if not mine:
                continue
            for c in range(len(CATEGORIES)):
                best = mine[int(np.argmax(scores[mine, c]))]
                target, weight = chosen.setdefault(best, (np.zeros(len(CATEGORIES), np.float32), np.zeros(len(CATEGORIES), np.float32)))
                share = targets[d, c]
                target[c], weight[c] = share > 0.5, abs(2 * share - 1) * (3.0 if share > 0.5 else 1.0)
                for o in range(len(CATEGORIES)):  # what a text has not, its window has not either
                    if targets[d, o] < 0.5 and not weight[o]:
                        weight[o] = 1 - 2 * targets[d, o]
            if targets[d].max() < 0.5:
                extra = mine[int(rng.integers(len(mine)))]
                chosen.setdefault(extra, (np.zeros(len(CATEGORIES), np.float32), np.ones(len(CATEGORIES), np.float32)))
        order = rng.permutation(sorted(chosen))
        size = min(batch, max(16, len(order) // 50))  # few labels take small batches, else there are too few steps
        for low in range(0, len(order), size):
            part = order[low : low + size]
            trainer.update(vocabulary, index[part], mask[part], np.stack([chosen[k][0] for k in part]), np.stack([chosen[k][1] for k in part]), rng)
        trainer.rate *= 0.88
    return net


def _typical(numbered: list[list[int]], targets: np.ndarray, size: int) -> np.ndarray:
    """Per category how much more texts with it hold each word than texts without any."""
    out = np.zeros((len(CATEGORIES), size), np.float32)
    without = np.zeros(size)
    none = max(1, int((targets.max(axis=1) < 0.5).sum())) if len(targets) else 1
    for n, t in zip(numbered, targets):
        if t.max() < 0.5:
            without[np.unique(np.array(n, dtype=np.int64))] += 1
    for c in range(len(CATEGORIES)):
        has = np.zeros(size)
        mine = [n for n, t in zip(numbered, targets) if t[c] > 0.5]
        for n in mine:
            has[np.unique(np.array(n, dtype=np.int64))] += 1
        out[c] = np.maximum(0, np.log((has + 0.1) / (len(mine) + 1)) - np.log((without + 0.5) / none)) * (has > 1)
    return out


# ---- over tables ----


def reviewer_shares(labels: DataFrame) -> DataFrame:
    """``doc_id`` and per category the share of the document's reviewers who saw it."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("reviewer").isNotNull() & F.col("category").isin("none", *CATEGORIES))
    seen = known.groupBy("doc_id", "reviewer").agg(*[F.max((F.col("category") == c).cast("double")).alias(c) for c in CATEGORIES])
    return seen.groupBy("doc_id").agg(*[F.avg(c).alias(c) for c in CATEGORIES])


def reviewed(labels: DataFrame) -> DataFrame:
    """``doc_id, categories``: what most of a document's reviewers saw in it."""
    found = F.array_compact(F.array(*[F.when(F.col(c) > 0.5, c) for c in CATEGORIES]))
    return reviewer_shares(labels).select("doc_id", found.alias("categories"))


def labelled_sample(docs: DataFrame, labels: DataFrame, most_labelled: int = 8000) -> tuple[list[str], np.ndarray]:
    """Texts and shares of at most ``most_labelled`` labelled documents, chosen by a hash of the id.

    A reviewer may see several categories in a document; rows without id, reviewer or category say nothing, repeated
    rows count once. The share of a category is that of the reviewers of the document who saw it.
    """
    shares = reviewer_shares(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    texts = docs.select(F.col("doc_id"), "text").where(F.col("text").isNotNull())
    # The sample has a bound, so that sending it to all tasks spares a shuffle of the texts.
    rows = texts.join(F.broadcast(shares), "doc_id").orderBy("doc_id").limit(most_labelled).collect()
    return [r.text for r in rows], np.array([[r[c] for c in CATEGORIES] for r in rows], dtype=np.float32).reshape(-1, len(CATEGORIES))


def score_documents(docs: DataFrame, nets: list[Net], threshold: float = 0.5) -> DataFrame:
    """``doc_id``, the score of each category, and ``categories``, those whose score reaches the threshold.

    A null or empty text scores 0; rows without id are left out; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast([(net.p, net.sizes) for net in nets])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = [_net(*x) for x in shared.value]
        for batch in batches:
            for low in range(0, len(batch), 1000):
                part = batch.iloc[low : low + 1000]
                scores = score_texts(here, part["text"].tolist())
                out = pd.DataFrame({"doc_id": part["doc_id"].to_numpy()})
                for c, name in enumerate(CATEGORIES):
                    out[name] = scores[:, c].astype(float)
                out["categories"] = [[name for c, name in enumerate(CATEGORIES) if s[c] >= threshold] for s in scores]
                yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ", ".join(f"{c} double" for c in CATEGORIES)
    return docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).mapInPandas(run, f"doc_id {kind}, {columns}, categories array<string>")


def trained(spark: SparkSession, texts: list[str], targets: np.ndarray, epochs: int = 10, seeds: tuple[int, ...] = SEEDS) -> list[Net]:
    """:func:`train` with each network in a task of its own."""
    sample = spark.sparkContext.broadcast((texts, targets))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for seed in batch["seed"]:
                net = fit(*sample.value, seed, epochs)
                yield pd.DataFrame({"seed": [seed], "net": [pickle.dumps((net.p, net.sizes))]})

    each = spark.range(len(seeds), numPartitions=len(seeds)).select(F.element_at(F.array(*map(F.lit, seeds)), (F.col("id") + 1).cast("int")).alias("seed"))
    rows = each.mapInPandas(run, "seed int, net binary").collect()  # one row a network, of fixed size
    return [_net(*pickle.loads(r.net)) for r in sorted(rows, key=lambda r: r.seed)]


def _net(p: dict, sizes: tuple) -> Net:
    net = Net.__new__(Net)
    net.p, net.sizes = p, sizes
    return net


def scored(docs: DataFrame, labels: DataFrame, most_labelled: int = 8000, epochs: int = 10) -> DataFrame:
    """:func:`score_documents` with a network trained on the labels. Without labelled documents every score is that of an untrained network and no category is given."""
    texts, targets = labelled_sample(docs, labels, most_labelled)
    if not len(texts):
        return score_documents(docs, [Net()], 2.0)
    return score_documents(docs, trained(docs.sparkSession, texts, targets, epochs))


def rates(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """Per source the documents and the share of them with each category; null sources are one source, spellings are folded."""
    sources = docs.select("doc_id", F.lower(F.trim("source")).alias("source"))
    both = scores.select("doc_id", "categories").join(sources, "doc_id")
    return both.groupBy("source").agg(F.count("*").alias("documents"), *[F.avg(F.array_contains("categories", c).cast("double")).alias(f"{c}_rate") for c in CATEGORIES])
