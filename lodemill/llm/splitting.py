"""Splitting oversized texts at natural boundaries, by balanced targets.

The size of a text is its characters that are not white space; a token is three of them. The least piece count that
the limit and the overlap allow gives equal-length targets; each is moved to the strongest boundary near it, the nearest
of equally strong ones; when a piece would break the limit, one more piece is planned and the targets are set anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 3

# The Unicode code points with the property White_Space.
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_WHITE = np.zeros(0x110000, dtype=bool)
_WHITE[[ord(c) for c in WHITE_SPACE]] = True


def token_count(text):
    """Characters that are not white space, by three, rounded down; null for null."""
    return (F.length(F.translate(text, WHITE_SPACE, "")) / CHARS_PER_TOKEN).cast("long")


def _boundaries(text: str, separators: list[str]) -> list[np.ndarray]:
    """Where a cut may fall, strongest first: the positions behind each separator. The empty one stands for any place."""
    out = []
    for separator in separators:
        if not separator:
            break
        found, at = [], text.find(separator)
        while at >= 0:
            found.append(at + len(separator))
            at = text.find(separator, at + 1)
        out.append(np.array(found, dtype=np.int64))
    return out


def cut(text: str, target_tokens: int, overlap: int, separators: list[str]) -> list[tuple[int, int]]:
    """The pieces of a text as (start, end). Together they cover it; each but the first starts ``overlap`` tokens early.

    A limit below one token counts as one, a negative overlap as none; an overlap that leaves no room is one token less
    than the limit.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    solid = np.concatenate([[0], np.cumsum(~_WHITE[points])])
    total = int(solid[-1])
    limit_tokens = max(1, target_tokens or 1)
    limit = CHARS_PER_TOKEN * limit_tokens + CHARS_PER_TOKEN - 1
    if total <= limit:
        return [(0, len(text))]
    shared = CHARS_PER_TOKEN * min(max(0, overlap or 0), limit_tokens - 1)
    fresh = limit - shared
    marks = _boundaries(text, separators)
    count = 1 + -(-(total - limit) // fresh)
    while True:
        pieces = _place(solid, marks, total, count, limit, shared)
        if pieces:
            return pieces
        count += 1


def _place(solid: np.ndarray, marks: list[np.ndarray], total: int, count: int, limit: int, shared: int) -> list[tuple[int, int]] | None:
    length = (total + (count - 1) * shared) / count
    step = length - shared
    slack = max(1.0, min(limit - length, step / 2))
    pieces, start, last = [], 0, 0
    for k in range(count - 1):
        target = length + k * step
        most = int(solid[start]) + limit
        low, high = max(target - slack, solid[last] + 1), min(target + slack, most)
        spot = None
        if low <= high:
            first, behind = int(np.searchsorted(solid, low, "left")), int(np.searchsorted(solid, high, "right"))
            for found in marks:
                near = found[np.searchsorted(found, first) : np.searchsorted(found, behind)]
                if len(near):
                    spot = int(near[np.argmin(np.abs(solid[near] - target))])
                    break
        if spot is None:
            spot = int(np.searchsorted(solid, min(max(round(target), int(solid[last]) + 1), most, total - 1), "left"))
        if spot <= last or solid[spot] - solid[start] > limit:
            return None
        pieces.append((start, spot))
        last = spot
        start = spot if not shared else max(0, int(np.searchsorted(solid, solid[spot] - shared, "right")) - 1)
    if total - solid[start] > limit or total <= solid[last]:
        return None
    pieces.append((start, len(solid) - 1))
    return pieces


def split_oversized(items: DataFrame, item_id: str, text: str, target_tokens: str, overlap: str, separators: str) -> DataFrame:
    """The pieces of the texts that are longer than their limit: ``item_id, piece, start, end, tokens, text``.

    Only such texts leave the JVM. A null text, limit or id gives no piece; a null overlap is none; without separators
    the cut falls at any place. Rows of the same id and text count once. Other columns are ignored.
    """
    long = (
        items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"), F.col(target_tokens).cast("int").alias("target"), F.coalesce(F.col(overlap).cast("int"), F.lit(0)).alias("overlap"), F.coalesce(F.col(separators), F.array(F.lit(""))).alias("separators"))
        .where(F.col("item_id").isNotNull() & F.col("target").isNotNull() & (token_count(F.col("text")) > F.greatest("target", F.lit(1))))
        .dropDuplicates(["item_id", "text"])
    )

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                for n, (a, b) in enumerate(cut(row.text, row.target, row.overlap, list(row.separators))):
                    piece = row.text[a:b]
                    out.append((row.item_id, n, a, b, sum(c not in WHITE_SPACE for c in piece) // CHARS_PER_TOKEN, piece))
            yield pd.DataFrame(out, columns=["item_id", "piece", "start", "end", "tokens", "text"])

    kind = long.schema["item_id"].dataType.simpleString()
    return long.mapInPandas(pieces, f"item_id {kind}, piece int, start int, end int, tokens int, text string")
