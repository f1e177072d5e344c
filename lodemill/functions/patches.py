"""Unified diffs, checked by hash before and after."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def apply_diff(text: str, diff: str) -> str | None:
    """The text after a unified diff; null if a line that it keeps or removes is not there, or a hunk is not as long as it says.

    Hunks come in order and are not moved. A line's end is part of it, ``\\ No newline at end of file`` takes it away.
    """
    old, out, at = text.splitlines(keepends=True), [], 0
    lines = diff.splitlines(keepends=True)
    n = 0
    while n < len(lines):
        head = _HUNK.match(lines[n])
        n += 1
        if not head:
            if lines[n - 1].startswith(("--- ", "+++ ", "diff ", "index ")) or not lines[n - 1].strip():
                continue
            return None
        start, gone, come = int(head[1]), int(head[2] or 1), int(head[4] or 1)
        start = start if gone == 0 else start - 1
        if not at <= start <= len(old):
            return None
        out += old[at:start]
        at = start
        while gone > 0 or come > 0 or (n < len(lines) and lines[n].startswith("\\")):
            if n >= len(lines):
                return None
            mark, body = lines[n][:1], lines[n][1:]
            n += 1
            if mark == "\\":
                if out and lines[n - 2][:1] in "+ ":
                    out[-1] = out[-1].rstrip("\r\n")
                continue
            bare = n < len(lines) and lines[n].startswith("\\")
            if mark in " -":
                if at >= len(old) or old[at] != (body.rstrip("\r\n") if bare else body):
                    return None
                at, gone = at + 1, gone - 1
            if mark in " +":
                out.append(body)
                come -= 1
            if mark not in " -+" or gone < 0 or come < 0:
                return None
    return "".join(out + old[at:])


def patched(text: Column, diff: Column, before: Column, after: Column) -> Column:
    """The patched text if the text has the hash ``before`` and the result the hash ``after``; null hashes ask nothing."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, diffs: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
        digest = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        out = []
        for t, d, a, b in zip(texts, diffs, old, new):
            fits = t is not None and d is not None and (a is None or digest(t) == a)
            result = apply_diff(t, d) if fits else None
            out.append(result if result is not None and (b is None or digest(result) == b) else None)
        return pd.Series(out, dtype=object)

    return run(text, diff, before, after)
