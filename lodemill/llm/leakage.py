"""Evaluation texts leaking into training text.

Windows of documents and of items get a SimHash of their words, each as often as it occurs. An item is cut into all its
windows of twelve words, the least passage that counts, and into all windows of its own size (the largest of twelve
times a power of two within four fifths of it); documents into the same sizes. A fingerprint is looked up by four blocks
of sixteen bits, each stored with all keys up to a fourth of the radius away, so that all fingerprints within the radius
are found. Candidates are verified by their exact weighted similarity over single words, and those with the same twelve
words in the same order are told apart. Short windows find parts and edits of a word here and there, windows of the
item's size find items whose words were moved about.

Items are a stated query set: they are indexed in blocks of a bounded number of words, some blocks at a time are sent to
all tasks. Documents are never shuffled; only the links found are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.llm.words import mix, word_hashes

WINDOW = 12
LARGEST = 192
RADIUS = 7
BATCH_WORDS = 40_000
BLOCKS, BLOCK_BITS = 4, 16


def fingerprints(hashes: np.ndarray, sizes: list[int], window: int = WINDOW) -> dict[int, np.ndarray]:
    """SimHash of the windows that begin at each word, per size: ``window`` times powers of two. Bits go by majority."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    kind = np.uint8 if max(sizes) < 256 else np.uint16
    size, sums, at = 1, bits.astype(kind), 0
    parts: list[np.ndarray] = []  # the sums of a window from those of powers of two
    left = window
    while left:
        if left & 1:
            parts.append((at, sums))
            at += size
        left >>= 1
        if left:
            sums = sums[:-size] + sums[size:] if len(sums) > size else sums[:0]
            size *= 2
    count = max(0, len(hashes) - window + 1)
    sums = np.zeros((count, 64), dtype=kind)
    for low, part in parts:
        sums += part[low : low + count]
    out, size = {}, window
    while size <= max(sizes):
        if size in sizes:
            out[size] = np.packbits(sums > size // 2, axis=1).view(np.uint64).ravel()
        sums = sums[:-size] + sums[size:] if len(sums) > size else sums[:0]
        size *= 2
    return out


def item_size(words: int, window: int = WINDOW) -> int:
    """The largest of ``window`` times a power of two within four fifths of an item and ``LARGEST``."""
    size = window
    while 2 * size <= min(0.8 * words, LARGEST):
        size *= 2
    return size


class Windows:
    """Windows of one size of a block of items, by the blocks of their fingerprints."""

    def __init__(self, starts: np.ndarray, owner: np.ndarray, prints: np.ndarray, radius: int):
        order = np.lexsort((owner, prints))
        self.starts, self.owner, self.prints, self.radius = starts[order], owner[order], prints[order], radius
        self.tables: list[tuple[np.ndarray, np.ndarray]] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": None}

    def _built(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per block of bits the first entry of each key, and the windows entered under it."""
        every = np.arange(1 << BLOCK_BITS, dtype=np.uint16)
        near = every[np.bitwise_count(every) <= self.radius // BLOCKS]
        out = []
        for k in range(BLOCKS):
            keys = ((self.prints >> np.uint64(k * BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.uint16)
            entered = (keys[:, None] ^ near).ravel()
            order = np.argsort(entered, kind="stable")
            first = np.concatenate([[0], np.cumsum(np.bincount(entered, minlength=1 << BLOCK_BITS))])
            out.append((first, (order // len(near)).astype(np.int32)))
        return out

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item window) within the radius, each once."""
        if self.tables is None:
            self.tables = self._built()
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, (first, entries) in enumerate(self.tables):
            value = ((prints >> np.uint64(k * BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.int64)
            count = first[value + 1] - first[value]
            hit = np.flatnonzero(count)
            for part in np.array_split(hit, max(1, int(count[hit].sum()) // 1_000_000)):
                n = count[part]
                a = np.repeat(part, n)
                b = entries[np.repeat(first[value[part]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                apart = prints[a] ^ self.prints[b]
                near = np.flatnonzero(np.bitwise_count(apart) <= self.radius)
                a, b, apart = a[near], b[near], apart[near]
                again = np.zeros(len(a), dtype=bool)
                for earlier in range(k):
                    again |= np.bitwise_count((apart >> np.uint64(earlier * BLOCK_BITS)) & np.uint64(0xFFFF)) <= self.radius // BLOCKS
                left.append(a[~again])
                right.append(b[~again].astype(np.int64))
        return np.concatenate(left), np.concatenate(right)


class ItemIndex:
    """A block of items: their words, and their windows by size."""

    def __init__(self, items: list[tuple], window: int = WINDOW, radius: int = RADIUS):
        self.window = window
        per = [word_hashes(text) for _, text in items]
        self.ids = [i for i, _ in items]
        self.hashes = np.concatenate([np.empty(0, np.uint64), *per])
        lengths = np.array([len(h) for h in per], dtype=np.int64)
        offsets = np.cumsum(lengths) - lengths
        own = [item_size(n, window) for n in lengths]
        self.windows: dict[int, Windows] = {}
        sizes = sorted({window, *own})
        prints = fingerprints(self.hashes, sizes, window)
        for size in sizes:
            mine = [k for k in range(len(per)) if lengths[k] >= size and size in (window, own[k])]
            starts = np.concatenate([np.empty(0, np.int64), *[np.arange(offsets[k], offsets[k] + lengths[k] - size + 1) for k in mine]])
            if len(starts):
                self.windows[size] = Windows(starts, np.repeat(mine, [lengths[k] - size + 1 for k in mine]), prints[size][starts], radius)

    def matches(self, per: list[np.ndarray], least: float, most_starts: int | None = None) -> list[tuple]:
        """Of word hashes per document: (document, item, windows, similarity, exact). Windows begin before ``most_starts``."""
        lengths = np.array([len(h) for h in per], dtype=np.int64)
        if not self.windows or not (lengths >= self.window).any():
            return []
        offsets = np.cumsum(lengths) - lengths
        hashes = np.concatenate(per)
        prints = fingerprints(hashes, list(self.windows), self.window)
        found = []
        for size, known in self.windows.items():
            step = 1 if size == self.window else size // 8
            count = np.maximum(0, np.minimum(lengths - size, (most_starts or len(hashes)) - 1) // step + 1)
            count[lengths < size] = 0
            owner = np.repeat(np.arange(len(per)), count)
            starts = step * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) + offsets[owner]
            a, b = known.candidates(prints[size][starts])
            for low in range(0, len(a), 20_000):
                x, y = a[low : low + 20_000], b[low : low + 20_000]
                mine = hashes[starts[x][:, None] + np.arange(size)]
                theirs = self.hashes[known.starts[y][:, None] + np.arange(size)]
                same = (mine == theirs).all(axis=1)
                similar = np.ones(len(x))
                similar[~same] = weighted_similarity(mine[~same], theirs[~same])
                keep = similar >= least
                found.append(pd.DataFrame({"d": owner[x[keep]], "i": known.owner[y[keep]], "w": starts[x[keep]] * 256 + size, "s": similar[keep], "e": same[keep]}))
        if not found:
            return []
        links = pd.concat(found).groupby(["d", "i"], sort=False).agg(w=("w", "nunique"), s=("s", "max"), e=("e", "any")).reset_index()
        return list(links.itertuples(index=False, name=None))


def _numbered(rows: np.ndarray) -> np.ndarray:
    """The words of each row in order, the second, third ... of the same made another word."""
    rows = np.sort(rows, axis=1)
    place = np.broadcast_to(np.arange(rows.shape[1]), rows.shape)
    new = np.ones(rows.shape, dtype=bool)
    new[:, 1:] = rows[:, 1:] != rows[:, :-1]
    return mix(mix(rows) ^ (place - np.maximum.accumulate(np.where(new, place, 0), axis=1)).astype(np.uint64))


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: words in both over words in either, each as often as it occurs."""
    out = np.empty(len(a))
    for low in range(0, len(a), 512):
        x, y = _numbered(a[low : low + 512]), _numbered(b[low : low + 512])
        both = (x[:, :, None] == y[:, None, :]).any(axis=2).sum(axis=1)
        out[low : low + 512] = both / (x.shape[1] + y.shape[1] - both)
    return out


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", window: int = WINDOW, radius: int = RADIUS, least: float = 0.8, block_words: int = 100_000, pass_blocks: int = 4) -> DataFrame:
    """One row per document and item of which it holds a passage: ``doc_id, item_id, windows, similarity, exact``.

    ``windows`` counts the document's windows that match one of the item's, ``exact`` tells that some match word by word.
    Null ids and texts, and texts of less than ``window`` words, match nothing; repeated rows count once; other columns
    are ignored. A block of items has at most ``block_words`` words, or one item. The documents are read once for every
    ``pass_blocks`` blocks, so once for up to 400,000 words of items.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    total = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = int(total // (4 * block_words)) + 1
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    kinds = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, item_id {asked.schema['item_id'].dataType.simpleString()}, windows int, similarity double, exact boolean"
    out = None
    for low in range(0, blocks, pass_blocks):
        indexes = []
        for block in range(low, min(blocks, low + pass_blocks)):
            part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).distinct().collect()
            indexes.append(spark.sparkContext.broadcast(ItemIndex([(r.item_id, r.text) for r in part], window, radius)))
        links = texts.mapInPandas(_matcher(indexes, window, least), kinds)
        out = links if out is None else out.unionByName(links)
    return out.groupBy("doc_id", "item_id").agg(F.max("windows").alias("windows"), F.max("similarity").alias("similarity"), F.max("exact").alias("exact"))


def _matcher(indexes: list, window: int, least: float):
    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = [index.value for index in indexes]

        def links(ids: list, per: list[np.ndarray]) -> list[tuple]:
            return [(ids[d], index.ids[i], w, s, e) for index in known for d, i, w, s, e in index.matches(per, least, BATCH_WORDS)]

        for batch in batches:
            ids, per, held, out = [], [], 0, []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                hashes = word_hashes(text)
                if len(hashes) < window:
                    continue
                for at in range(0, len(hashes), BATCH_WORDS):  # a very long text goes in pieces that share a window
                    piece = hashes[at : at + BATCH_WORDS + max(window, LARGEST) - 1]
                    ids.append(doc)
                    per.append(piece)
                    held += len(piece)
                    if held >= BATCH_WORDS:
                        out += links(ids, per)
                        ids, per, held = [], [], 0
            out += links(ids, per) if per else []
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "windows", "similarity", "exact"])

    return match
