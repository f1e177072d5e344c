"""Chunks of texts by a hierarchy of separators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Separators from the strongest to none.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def tokens(text: str) -> int:
    solid = len("".join(text.split()))
    return max(1, solid // 3) if text else 0


def pieces(text: str, target: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces within the target: parts between separators joined as long as they fit, larger ones cut by the next separator.

    Separators at the edge of a piece vanish. The empty separator cuts every ``3 * target`` characters; without it a part
    that no separator cuts stays whole.
    """
    if tokens(text) <= target:
        return [text]
    for level, separator in enumerate(separators):
        if separator == "":
            step = 3 * target
            return [text[i : i + step] for i in range(0, len(text), step)]
        if separator in text:
            break
    else:
        return [text]
    out: list[str] = []
    held: str | None = None
    size = 0
    for part in text.split(separator):
        extra = len("".join(part.split())) + len("".join(separator.split()))
        if held is not None and max(1, (size + extra) // 3) <= target:
            held, size = held + separator + part, size + extra
        else:
            if held:
                out.append(held)
            held, size = part, len("".join(part.split()))
    if held:
        out.append(held)
    rest = separators[level + 1 :]
    return [q for p in out for q in (pieces(p, target, rest) if tokens(p) > target and rest else [p])]


def with_overlap(parts: list[str], overlap: int) -> list[str]:
    """Each part but the first begins with the tail of the part before it that holds ``overlap`` characters that are not white space, one at least."""
    out = parts[:1]
    for before, part in zip(parts, parts[1:]):
        left, at = max(1, overlap), len(before)
        while at > 0 and left > 0:
            at -= 1
            left -= not before[at].isspace()
        out.append(before[at:] + part)
    return out


def chunked(texts: DataFrame, target: int = 512, overlap: int = 64, key: str = "id", text: str = "text") -> DataFrame:
    """``id, ordinal, text, tokens``: the chunks of each text; blank and null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rid, t in zip(batch["key"], batch["text"]):
                if t and t.strip():
                    parts = pieces(t, target)
                    rows += [(rid, n, p, tokens(p)) for n, p in enumerate(with_overlap(parts, overlap) if len(parts) > 1 else parts)]
            yield pd.DataFrame(rows, columns=[key, "ordinal", "text", "tokens"])

    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"{key} {rows.schema['key'].dataType.simpleString()}, ordinal int, text string, tokens int")
