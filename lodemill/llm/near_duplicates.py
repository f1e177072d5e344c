"""Near-duplicate records: SuperMinHash signatures, banding, exact verification and union-find grouping.

Records of the same words are one class, so copies cost one signature and one verification, however many there are. The
slots of a signature are cut into bands, as many and as wide as the threshold asks for; classes that share a band are
candidates. Two bits of each slot make a sketch that drops candidates far from the threshold before any text is fetched,
and the distinct shingles of both texts decide. Which keys hold more than one class is found by aggregation over
fixed-width rows; only keys with three classes or more are joined, and adaptive skew joins split the busy ones.

Pairs are all pairs of classes. Groups need no more than what connects them: the classes of a busy key are first held
against its least class alone, and only those that this leaves apart are held against the rest of the key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodemill.llm.components import link_groups
from lodemill.llm.words import mix, shingles, word_hash, words
from lodemill.session import Scratch

REPRESENTATIVES = 8
_RANK = np.uint64(56)
_BATCH = 20_000


def bands_for(least: float, miss: float = 7e-4, most_slots: int = 120) -> tuple[int, int]:
    """Bands and rows a band, as many rows as go: a pair at the threshold shares no band with a chance of ``miss`` at most."""
    for rows in range(12, 0, -1):
        hit = min(least**rows, 1 - 1e-12)
        bands = max(1, math.ceil(math.log(miss) / math.log1p(-hit))) if hit > 0 else most_slots + 1
        if bands * rows <= most_slots or rows == 1:
            return bands, rows
    raise AssertionError


def long_signature(elements: np.ndarray, slots: int) -> np.ndarray:
    """The signature of one large set from those of its parts: the least value of each slot."""
    parts = [signatures(elements[low : low + _BATCH], np.zeros(len(elements[low : low + _BATCH]), np.int64), 1, slots) for low in range(0, len(elements), _BATCH)]
    return np.min(parts, axis=0)


def signatures(elements: np.ndarray, owner: np.ndarray, count: int, slots: int) -> np.ndarray:
    """SuperMinHash: per set a row of ``slots`` values, each a rank and a random part; all ones where a set is empty.

    Element and step give the random part and the next entry of the element's random permutation, so an element meets
    each slot once, at a rank. No later rank can lower a signature whose slots all have a rank already: such sets stop.
    """
    out = np.full((count, slots), np.uint64(0xFFFFFFFFFFFFFFFF))
    turn = np.tile(np.arange(slots, dtype=np.uint16), (len(elements), 1))
    rows = np.arange(len(elements))
    for j in range(slots):
        open_sets = out.max(axis=1) >= np.uint64(j) << _RANK
        rows = rows[open_sets[owner[rows]]]
        if not len(rows):
            break
        with np.errstate(over="ignore"):
            random = mix(elements[rows] + np.uint64(j + 1) * np.uint64(0xD1B54A32D192ED03))
        pick = j + ((random >> np.uint64(40)) % np.uint64(slots - j)).astype(np.int64)
        slot = turn[rows, pick]
        turn[rows, pick] = turn[rows, j]
        turn[rows, j] = slot
        with np.errstate(over="ignore"):
            value = (np.uint64(j) << _RANK) | (mix(random) >> np.uint64(8))
        np.minimum.at(out.reshape(-1), owner[rows] * slots + slot, value)
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key per band of ``rows`` slots; the number of the band is part of it."""
    count, slots = signature.shape
    bands = slots // rows
    parts = signature[:, : bands * rows].reshape(count, bands, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7), (count, bands))
        for k in range(rows):
            key = mix(key * np.uint64(0x9DDFEA08EB382D69) ^ parts[:, :, k])
    return key


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Elements in both over elements in either, of two sorted arrays of distinct elements; 0 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 0.0


def text_class(kind: str, w: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(f"{kind}\0{' '.join(w)}".encode("utf-8", "surrogatepass"))


def _signed(shingle: int, least_words: int, bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, size = [], 0
            for kind, rid, text in zip(batch["kind"], batch["id"], batch["text"]):
                w = words(text)
                if len(w) < max(least_words, shingle):
                    continue
                elements = np.unique(shingles(np.fromiter(map(word_hash, w), dtype=np.uint64), shingle))
                if len(elements) > _BATCH and held:  # a long text goes alone
                    yield _rows(held, bands, rows)
                    held, size = [], 0
                held.append((kind, rid, text_class(kind, w), elements))
                size += len(elements)
                if size >= _BATCH:
                    yield _rows(held, bands, rows)
                    held, size = [], 0
            if held:  # a frame without rows has no type that Arrow can make lists of
                yield _rows(held, bands, rows)

    return run


def _rows(held: list[tuple], bands: int, rows: int) -> pd.DataFrame:
    first = {}
    for n, h in enumerate(held):
        first.setdefault(h[2], n)
    number = {c: k for k, c in enumerate(first)}
    sets = [held[n][3] for n in first.values()]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if len(sets) == 1 and len(sets[0]) > _BATCH:
        signed = long_signature(sets[0], bands * rows)
    else:
        signed = signatures(np.concatenate([np.empty(0, np.uint64), *sets]), owner, len(sets), bands * rows)
    kinds = np.array([word_hash(str(held[n][0])) for n in first.values()], dtype=np.uint64)
    keys = mix(band_keys(signed, rows) ^ kinds[:, None]).view(np.int64)
    random = mix(signed)
    sketch = np.concatenate([_plane((random >> np.uint64(k)) & np.uint64(1)) for k in (0, 1)], axis=1)
    return pd.DataFrame(
        {
            "kind": [h[0] for h in held],
            "id": [h[1] for h in held],
            "cls": [h[2] for h in held],
            "keys": [keys[number[h[2]]] for h in held],
            "sketch": [sketch[number[h[2]]] for h in held],
        }
    )


def _plane(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit numbers."""
    out = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), dtype=np.uint8)
    out[:, : bits.shape[1]] = bits
    return np.packbits(out, axis=1).view(np.int64)


def sketch_limit(slots: int, least: float, deviations: float = 3.5) -> int:
    """Most slots whose two bits may differ: what a pair just ``least`` similar has, and some standard deviations more."""
    p = (1 - least) * 3 / 4
    return int(slots * p + deviations * (slots * p * (1 - p)) ** 0.5)


class NearDuplicates:
    """The classes of a collection and the pairs of classes at least ``least`` similar.

    ``records`` has ``kind, id, text``; only records of one kind are compared. Null ids and texts and texts of less than
    ``least_words`` words take no part; repeated rows count once; other columns are ignored; an empty table has no pairs.
    ``shingle`` is the number of consecutive words that are compared.
    """

    def __init__(self, records: DataFrame, shingle: int = 5, least: float = 0.8, least_words: int = 8):
        bands, rows = bands_for(least)
        self.shingle, self.least, self.limit = shingle, least, sketch_limit(bands * rows, least)
        self.longs = -(-bands * rows // 64)
        self.scratch = Scratch(records.sparkSession)
        self.records = records.select("kind", "id", "text").where(F.col("id").isNotNull() & F.col("text").isNotNull())
        signed = self.records.mapInPandas(_signed(shingle, least_words, bands, rows), "kind string, id string, cls binary, keys array<bigint>, sketch array<bigint>")
        signed = self.scratch.write(signed)
        members = signed.select("kind", "cls", "id")
        order = Window.partitionBy("kind", "cls").orderBy("id")
        few = members.withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= REPRESENTATIVES)
        few = few.groupBy("kind", "cls").agg(F.sort_array(F.collect_set("id")).alias("reps"))
        body = signed.groupBy("kind", "cls").agg(F.first(F.struct("keys", "sketch")).alias("b"))
        classes = few.join(body, ["kind", "cls"]).select("kind", "cls", "reps", "b.keys", "b.sketch")
        self.classes = self.scratch.write(classes.withColumn("no", F.monotonically_increasing_id()))
        # Keys are kept once per class only: of the records the class is enough.
        self.members = self.scratch.write(members)
        self.scratch.drop(signed)

    def _keys(self) -> tuple[DataFrame, DataFrame]:
        """``no, key`` of the classes and ``key, n, a, b`` of the keys that several classes have: how many, the least and the largest."""
        rows = self.classes.select("no", F.explode("keys").alias("key")).repartition("key")
        return rows, rows.groupBy("key").agg(F.count("*").alias("n"), F.min("no").alias("a"), F.max("no").alias("b")).where(F.col("n") > 1)

    def _sketched(self, rows: DataFrame, number: str, suffix: str) -> DataFrame:
        sketches = self.classes.select(F.col("no").alias(number), F.col("kind").alias(f"kind_{suffix}"), F.col("sketch").alias(f"s{suffix}"))
        return rows.join(sketches, number)

    def _alike(self):
        """Whether the sketches ``sa`` and ``sb`` are of one kind and differ in few slots."""
        apart = [F.col("sa")[k].bitwiseXOR(F.col("sb")[k]) for k in range(2 * self.longs)]
        differ = sum((F.bit_count(apart[k].bitwiseOR(apart[k + self.longs])) for k in range(self.longs)), F.lit(0))
        return F.col("kind_a").eqNullSafe(F.col("kind_b")) & (differ <= self.limit)

    def _near(self, pairs: DataFrame) -> DataFrame:
        return self._sketched(self._sketched(pairs, "a", "a"), "b", "b").where(self._alike()).select("a", "b")

    def _all_candidates(self) -> DataFrame:
        rows, keys = self._keys()
        two = self._near(keys.where(F.col("n") == 2).select("a", "b"))
        busy = rows.join(keys.where(F.col("n") > 2).select("key"), "key", "left_semi")
        left, right = (self._sketched(busy.select("key", F.col("no").alias(x)), x, x) for x in "ab")
        return two.unionByName(left.join(right, "key").where((F.col("a") < F.col("b")) & self._alike()).select("a", "b")).distinct()

    def pairs(self) -> DataFrame:
        """``a, b, similarity`` of all pairs of classes at least ``least`` similar, as a written table."""
        return self.scratch.write(self._verified(self._all_candidates()))

    def _texts(self, pairs: DataFrame) -> DataFrame:
        """``no, text`` of the classes in the pairs, fetched from the records by the least id of each class."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("no")).distinct()
        wanted = self.classes.join(wanted, "no").select("no", "kind", "cls", F.element_at("reps", 1).alias("id"))

        def same(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:  # an id may have had another text
                fits = [text_class(kind, words(text)) == bytes(cls) for kind, text, cls in zip(batch["kind"], batch["text"], batch["cls"])]
                yield batch[fits][["no", "text"]]

        found = self.records.join(wanted, ["kind", "id"]).select("no", "kind", "cls", "text").mapInPandas(same, "no bigint, text string")
        return found.groupBy("no").agg(F.first("text").alias("text"))

    def _verified(self, candidates: DataFrame) -> DataFrame:
        shingle, least = self.shingle, self.least
        pairs = self.scratch.write(candidates)
        text = self.scratch.write(self._texts(pairs))
        both = pairs.join(text.select(F.col("no").alias("a"), F.col("text").alias("text_a")), "a").join(text.select(F.col("no").alias("b"), F.col("text").alias("text_b")), "b")

        def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                known: dict[int, np.ndarray] = {}

                def elements(no: int, text: str) -> np.ndarray:
                    if no not in known:
                        known[no] = np.unique(shingles(np.fromiter(map(word_hash, words(text)), dtype=np.uint64), shingle))
                    return known[no]

                found = [similarity(elements(r.a, r.text_a), elements(r.b, r.text_b)) for r in batch.itertuples(index=False)]
                out = batch[["a", "b"]].assign(similarity=np.array(found, dtype=float))
                yield out[out["similarity"] >= least]

        return both.select("a", "b", "text_a", "text_b").mapInPandas(verify, "a bigint, b bigint, similarity double")

    def found_pairs(self) -> DataFrame:
        """``kind, id_a, id_b`` with id_a < id_b.

        The least ids of a class represent it, eight at most: they are paired with each other and with those of every
        similar class. Each further member is paired with the least id of its class.
        """
        one = self.classes.where(F.size("reps") > 1).select("kind", F.explode("reps").alias("id_a"), "reps").select("kind", "id_a", F.explode("reps").alias("id_b"))
        least = self.classes.where(F.size("reps") == REPRESENTATIVES).select("kind", "cls", F.element_at("reps", 1).alias("id_a"))
        rest = self.members.join(least, ["kind", "cls"]).select("kind", "id_a", F.col("id").alias("id_b"))
        reps = self.classes.select("no", "kind", "reps")
        two = (
            self.pairs().join(reps.select(F.col("no").alias("a"), "kind", F.col("reps").alias("ra")), "a")
            .join(reps.select(F.col("no").alias("b"), F.col("reps").alias("rb")), "b")
            .select("kind", F.explode("ra").alias("x"), "rb")
            .select("kind", "x", F.explode("rb").alias("y"))
            .select("kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        )
        return one.unionByName(rest).unionByName(two).where(F.col("id_a") < F.col("id_b")).distinct()

    def _links(self) -> DataFrame:
        """Verified pairs that connect all classes that :meth:`pairs` would connect, in number linear in the classes.

        A class is held against the least class of its busiest key and of the key whose least class is least. Classes of
        a key that are connected by then need no more; the others, but those of the key's largest component, are held
        against all classes of the key in other components.
        """
        rows, keys = self._keys()
        two = keys.where(F.col("n") == 2).select("a", "b")
        busy = self.scratch.write(rows.join(keys.where(F.col("n") > 2).select("key", "n", F.col("a").alias("pivot")), "key"))
        stars = busy.groupBy("no").agg(F.min("pivot").alias("p"), F.max_by("pivot", F.struct("n", "pivot")).alias("q"))
        stars = stars.select(F.explode(F.array("p", "q")).alias("a"), F.col("no").alias("b")).where(F.col("a") != F.col("b"))
        first = self.scratch.write(self._verified(self._near(two.unionByName(stars).distinct())))
        roots = self._roots(first)
        busy = busy.join(roots.select(F.col("member").alias("no"), F.col("group_id").alias("g")), "no", "left").select("key", "no", F.coalesce("g", "no").alias("root"))
        busy = self.scratch.write(busy)
        each = busy.groupBy("key", "root").agg(F.count("*").alias("n"))
        apart = each.groupBy("key").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("largest")).where(F.col("roots") > 1)
        others = busy.join(apart.select("key", "largest"), "key").where(F.col("root") != F.col("largest")).select("key", F.col("no").alias("a"), F.col("root").alias("root_a"))
        rest = busy.join(apart.select("key"), "key", "left_semi").select("key", F.col("no").alias("b"), F.col("root").alias("root_b"))
        both = self._sketched(others, "a", "a").join(self._sketched(rest, "b", "b"), "key").where((F.col("root_a") != F.col("root_b")) & self._alike())
        second = self._verified(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        return self.scratch.write(first.unionByName(second))

    def _roots(self, links: DataFrame) -> DataFrame:
        return self.scratch.write(link_groups(links.select("a", "b").mapInPandas(_union_find, "a bigint, b bigint"), "a", "b"))

    def groups(self) -> DataFrame:
        """One row per record that takes part: ``kind, id, group_id``, the least id of all records linked to it, directly or through others."""
        linked = self._roots(self._links()).select(F.col("member").alias("no"), "group_id")
        classes = self.classes.select("no", "kind", "cls", F.element_at("reps", 1).alias("least")).join(linked, "no", "left")
        classes = classes.select("kind", "cls", "least", F.coalesce("group_id", "no").alias("root"))
        names = classes.groupBy("root").agg(F.min("least").alias("group_id"))
        named = classes.join(names, "root").select("kind", "cls", "group_id")
        return self.members.distinct().join(named, ["kind", "cls"]).select("kind", "id", "group_id")


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of a batch that join two of its trees: a spanning forest, so that what is left to consolidate is small."""
    for batch in batches:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out = []
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                up[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
        yield pd.DataFrame(out, columns=["a", "b"])
