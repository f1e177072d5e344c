"""What files are by their first bytes, and what is told by headers and by tools' reports."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First bytes of a format (offset, hex) and its media type.
SIGNATURES = [
    (0, "89504E470D0A1A0A", "image/png"),
    (0, "FFD8FF", "image/jpeg"),
    (0, "474946383761", "image/gif"),
    (0, "474946383961", "image/gif"),
    (0, "424D", "image/bmp"),
    (0, "49492A00", "image/tiff"),
    (0, "4D4D002A", "image/tiff"),
    (0, "255044462D", "application/pdf"),
    (0, "664C6143", "audio/flac"),
    (0, "4F676753", "audio/ogg"),
    (0, "494433", "audio/mpeg"),
    (0, "1A45DFA3", "video/webm"),
    (0, "504B0304", "application/zip"),
]
# A member that tells the kind of an Office file.
OFFICE = {
    "word/": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xl/": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "ppt/": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}


def _at(content: Column, offset: int, size: int) -> Column:
    return F.hex(F.substring(content, offset + 1, size))


def media_type(content: Column) -> Column:
    """The media type by signature; brands part the ISO container, null where nothing fits."""
    brand = F.decode(F.substring(content, 9, 4), "ISO-8859-1")
    kind = F.when(_at(content, 4, 4) == "66747970", F.when(brand.isin("M4A ", "M4B "), "audio/mp4").when(brand == "qt  ", "video/quicktime").otherwise("video/mp4"))
    riff = F.decode(F.substring(content, 9, 4), "ISO-8859-1")
    kind = kind.when(_at(content, 0, 4) == "52494646", F.when(riff == "WAVE", "audio/wav").when(riff == "WEBP", "image/webp").when(riff == "AVI ", "video/x-msvideo"))
    for offset, magic, mime in SIGNATURES:
        kind = kind.when(_at(content, offset, len(magic) // 2) == magic, mime)
    return kind


def _number(content: Column, offset: int, size: int, little: bool = False) -> Column:
    parts = [_at(content, offset + k, 1) for k in range(size)]
    return F.conv(F.concat(*(reversed(parts) if little else parts)), 16, 10).cast("long")


def dimensions(content: Column) -> Column:
    """``struct<width, height>`` of PNG, GIF and BMP headers; null for others. A negative height of a BMP is its size."""
    mime = media_type(content)
    high = _number(content, 22, 4, True)
    high = F.when(high >= 2**31, 2**32 - high).otherwise(high)
    pick = lambda png, gif, bmp: F.when(mime == "image/png", png).when(mime == "image/gif", gif).when(mime == "image/bmp", bmp)
    size = F.struct(pick(_number(content, 16, 4), _number(content, 6, 2, True), _number(content, 18, 4, True)).alias("width"), pick(_number(content, 20, 4), _number(content, 8, 2, True), high).alias("height"))
    return F.when(size["width"].isNotNull() & size["height"].isNotNull(), size)


def pdf_pages(content: Column) -> Column:
    """How many page objects the first two megabytes of a PDF name; null for none."""
    text = F.decode(F.substring(content, 1, 2_000_000), "ISO-8859-1")
    found = F.size(F.regexp_extract_all(text, F.lit(r"(/Type\s*/Page)(?![a-zA-Z])"), 1))
    return F.when(found > 0, found)


def is_intact(content: Column, digest: Column) -> Column:
    return F.sha2(content, 256).eqNullSafe(F.lower(digest))


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the first frame header; segments are walked by their lengths."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF or marker == 0x01 or 0xD0 <= marker <= 0xD9:
            at += 1 if marker == 0xFF else 2
            continue
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def wav_report(data: bytes) -> tuple[int, int, int, int] | None:
    """(channels, sample rate, bits, milliseconds) of a WAV file; a data size beyond the file is what the file holds."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"fmt " and at + 24 <= len(data):
            form = struct.unpack("<HHIIHH", data[at + 8 : at + 24])
        elif name == b"data" and form:
            held = min(size, len(data) - at - 8)
            _, channels, rate, per_second, _, bits = form
            return (channels, rate, bits, held * 1000 // per_second) if per_second else None
        at += 8 + size + (size & 1)
    return None


def zip_report(data: bytes) -> tuple[str | None, bool]:
    """The Office type of a zip by its members, and whether a member is encrypted; (None, False) for no zip."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = z.infolist()
    except (zipfile.BadZipFile, ValueError, NotImplementedError):
        return None, False
    names = [i.filename for i in infos]
    kind = next((mime for prefix, mime in OFFICE.items() if any(n.startswith(prefix) for n in names)), None) if "[Content_Types].xml" in names else None
    return kind, any(i.flag_bits & 1 for i in infos)


_DESCRIPTION = "path string, media_type string, width bigint, height bigint, duration_ms bigint, pages int, encrypted boolean, mismatch boolean"


def describe(files: DataFrame) -> DataFrame:
    """``path, media_type, width, height, duration_ms, pages, encrypted, mismatch`` of ``path, content``.

    What columns can tell is told by columns; only JPEG, WAV and zip files go through Python. ``mismatch``: the suffix
    belongs to another type. Null and empty contents have a null type.
    """
    size = dimensions(F.col("content"))
    told = files.select("path", "content", media_type(F.col("content")).alias("m"), size["width"].alias("w"), size["height"].alias("h"), pdf_pages(F.col("content")).alias("p"))
    ready = told.select("path", "m", "w", "h", F.when(F.col("m") == "application/pdf", F.col("p")).alias("p"), F.when(F.col("m").isin("image/jpeg", "audio/wav", "application/zip"), F.col("content")).alias("deep"), F.when(F.col("m") == "application/pdf", F.contains(F.decode(F.substring("content", 1, 1_000_000), "ISO-8859-1"), F.lit("/Encrypt"))).alias("locked"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, mime, w, h, pages, deep, locked in batch.itertuples(index=False, name=None):
                whole = lambda x: None if x is None or pd.isna(x) else int(x)
                w, h, pages, ms, encrypted = whole(w), whole(h), whole(pages), None, bool(locked) if locked is not None and not pd.isna(locked) else False
                if deep is not None:
                    data = bytes(deep)
                    if mime == "image/jpeg":
                        w, h = jpeg_size(data) or (None, None)
                    elif mime == "audio/wav":
                        ms = (wav_report(data) or (None,) * 4)[3]
                    else:
                        office, encrypted = zip_report(data)
                        mime = office or mime
                known = SUFFIXES.get(path.rsplit(".", 1)[-1].lower()) if path and "." in path else None
                out.append((path, mime, w, h, ms, pages, encrypted, known is not None and mime is not None and known != mime))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _DESCRIPTION.split(", ")], dtype=object)

    return ready.mapInPandas(run, _DESCRIPTION)


# The media type that a suffix stands for.
SUFFIXES = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp",
    "pdf": "application/pdf", "wav": "audio/wav", "mp3": "audio/mpeg", "flac": "audio/flac", "ogg": "audio/ogg", "m4a": "audio/mp4", "mp4": "video/mp4", "mov": "video/quicktime",
    "webm": "video/webm", "avi": "video/x-msvideo", "zip": "application/zip", "docx": OFFICE["word/"], "xlsx": OFFICE["xl/"], "pptx": OFFICE["ppt/"],
}


def frame_rate(text: Column) -> Column:
    """``30000/1001`` or a number; null if malformed or over zero."""
    parts = F.split(text, "/")
    over = F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("double"), F.when(F.size(parts) == 1, F.lit(1.0)))
    return F.try_divide(F.try_element_at(parts, F.lit(1)).try_cast("double"), over)


_STREAM = "struct<codec_type:string,codec_name:string,width:int,height:int,duration:string,avg_frame_rate:string,r_frame_rate:string>"


def probe_report(json: Column) -> Column:
    """The first video stream of a probe's JSON: codec, size, milliseconds (stream's, else container's), rate and whether it varies by over 1 %."""
    report = F.from_json(json, f"struct<streams:array<{_STREAM}>,format:struct<duration:string>>")
    video = F.try_element_at(F.filter(report["streams"], lambda s: s["codec_type"] == "video"), F.lit(1))
    audio = F.exists(report["streams"], lambda s: s["codec_type"] == "audio")
    seconds = F.coalesce(video["duration"].try_cast("double"), report["format"]["duration"].try_cast("double"))
    mean, nominal = frame_rate(video["avg_frame_rate"]), frame_rate(video["r_frame_rate"])
    return F.when(
        video.isNotNull(),
        F.struct(video["codec_name"].alias("codec"), video["width"].alias("width"), video["height"].alias("height"), F.bround(seconds * 1000).cast("long").alias("duration_ms"), mean.alias("frame_rate"), F.coalesce(F.abs(mean - nominal) > 0.01 * nominal, F.lit(False)).alias("variable_rate"), audio.alias("has_audio")),
    )


def scene_times(text: Column) -> Column:
    """Sorted distinct milliseconds of the presentation times in a filter's log."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"pts_time:\s*([0-9.]+)"), 1), lambda x: F.bround(x.try_cast("double") * 1000).cast("long"))
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def is_sufficient(pages: DataFrame, least_chars: int = 200, share: float = 0.6) -> DataFrame:
    """``id, sufficient``: whether the share of pages with little text, missing ones included, stays below ``share``.

    ``pages(id, page_count, page, text)``; the count is that of the document, pages without a row have no text.
    """
    rich = pages.where(F.length(F.trim("text")) >= least_chars).groupBy("id").agg(F.countDistinct("page").alias("rich"))
    counts = pages.groupBy("id").agg(F.max("page_count").alias("n"))
    both = counts.join(rich, "id", "left")
    poor = 1 - F.coalesce("rich", F.lit(0)) / F.col("n")
    return both.select("id", (F.coalesce(poor, F.lit(1.0)) < share).alias("sufficient"))


class _Text(HTMLParser):
    SKIP = {"script", "style", "head", "template", "noscript"}
    BLOCK = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol", "pre", "blockquote"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.SKIP
        if tag in self.BLOCK:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in self.SKIP))
        if tag in self.BLOCK:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_text(html: str | None) -> str:
    """The visible text of a page, a line a block; empty for null and for nothing."""
    if not html:
        return ""
    parser = _Text()
    parser.feed(html)
    parser.close()
    lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(parser.parts).split("\n"))
    return "\n".join(x for x in lines if x)


def extract_text(files: DataFrame) -> DataFrame:
    """``path, text`` of ``path, content``: HTML without tags, other texts as UTF-8; empty for binary, null or failing contents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                data = bytes(content) if content is not None else b""
                text = "" if b"\0" in data[:4096] else data.decode("utf-8", "replace")
                head = text[:512].lstrip().lower()
                out.append((path, html_text(text) if head.startswith(("<!doctype html", "<html")) or (path or "").lower().endswith((".html", ".htm")) else text))
            yield pd.DataFrame(out, columns=["path", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def alike(a: pd.Series, b: pd.Series, least: float = 0.0) -> pd.Series:
    """The ratio of two texts, or 0 where cheap upper bounds show that it is below ``least``."""
    from difflib import SequenceMatcher

    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        m = SequenceMatcher(None, x, y)
        far = least > 0 and (m.real_quick_ratio() < least or m.quick_ratio() < least)
        out.append(0.0 if far else m.ratio())
    return pd.Series(out, dtype="float64")


def _ratio(least: float):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return alike(a, b, least)

    return run


def is_text_copy(a: Column, b: Column, least: float = 0.6) -> Column:
    """Whether two texts are alike by their longest matching blocks; null if one is null."""
    return F.pandas_udf(_ratio(least), "double")(a, b) >= least


def overlap_ratio(a: Column, b: Column) -> Column:
    """How alike two texts are by their longest matching blocks; null if one is null."""
    return F.pandas_udf(_ratio(0.0), "double")(a, b)
