"""Paths: what they may be, which files are taken, and media types by suffix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodemill.functions.text import base_name, extension, is_within
from lodemill.operators.media import SUFFIXES

# Names that no part of a path may have, and the lengths it may have.
RESERVED = ("CON", "PRN", "AUX", "NUL", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9", "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9")
PATH_LENGTH, PART_LENGTH = 4096, 255


def path_fault(path: Column, root: str) -> Column:
    """Why a path is refused below a root, null if it is not: ``non_canonical``, ``cross_workspace``, ``traversal`` or ``special``.

    Absolute paths must lie within the root and are judged by what lies below it. The first faulty part decides. Links are
    the file system's business and are not looked at.
    """
    absolute = path.startswith("/")
    inner = F.when(absolute, F.substring(path, len(root.rstrip("/")) + 2, PATH_LENGTH)).otherwise(path)
    parts = F.filter(F.split(inner, "/"), lambda p: (p != "") & (p != "."))  # a path reads past empty parts and dots
    fault = F.transform(parts, lambda p: F.when(p == "..", "traversal").when(F.upper(p).isin(*RESERVED), "special").when(F.length(p) > PART_LENGTH, "non_canonical"))
    first = F.try_element_at(F.array_compact(fault), F.lit(1))
    return F.when(path.isNull() | (F.trim(path) == "") | (F.length(path) > PATH_LENGTH), "non_canonical").when(absolute & ~is_within(path, F.lit(root)), "cross_workspace").otherwise(first)


def _tail_regex(pattern: str) -> str:
    """A pattern of whole path parts that must match at the end; stars stay within a part, two stars are one part."""
    part = {"*": "[^/]*", "?": "[^/]"}
    pieces = ["".join(part.get(c, c if c.isalnum() or c == "_" else "\\" + c) for c in p.replace("**", "*")) for p in pattern.strip("/").split("/")]
    return "(?:^|/)" + "/".join(pieces) + "$"


def is_supported(path: Column, size: Column, include: list[str], exclude: list[str], reserved: str = ".", most_bytes: int = 20 * 1024 * 1024) -> Column:
    """Whether a file is taken: no reserved prefix of its name, not too large, its tail as included and not as excluded."""
    of = lambda patterns: F.lit(False) if not patterns else path.rlike("|".join(map(_tail_regex, patterns)))
    return F.coalesce(~base_name(path).startswith(reserved) & (size <= most_bytes) & (of(include) | path.isin(*include)) & ~of(exclude), F.lit(False))


def mime_by_suffix(path: Column) -> Column:
    """The media type that a suffix stands for, ``application/octet-stream`` for others."""
    known = F.create_map(*[F.lit(x) for suffix, mime in {**SUFFIXES, "md": "text/markdown", "txt": "text/plain"}.items() for x in ("." + suffix, mime)])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("application/octet-stream"))


def escalates(files: Column, tokens: Column, question: Column, words: list[str], most_files: int = 4, most_tokens: int = 2500) -> Column:
    """Whether a question is for the larger model: many files, many tokens, or one of the words in it."""
    out = (files >= most_files) | (tokens >= most_tokens)
    for w in words:
        out = out | F.contains(F.lower(question), F.lit(w))
    return F.coalesce(out, F.lit(False))
