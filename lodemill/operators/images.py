"""What images tell about themselves: depth, colour, transparency, orientation and where they were taken."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.operators.media import jpeg_size, media_type

# Colour types of PNG, component counts of JPEG, tags of EXIF, bytes of its field types.
PNG_COLOURS = {0: "grayscale", 2: "rgb", 3: "palette", 4: "grayscale_alpha", 6: "rgba"}
JPEG_COLOURS = {1: "grayscale", 3: "ycbcr", 4: "cmyk"}
ORIENTATION, GPS = 0x0112, 0x8825
LATITUDE_REF, LATITUDE, LONGITUDE_REF, LONGITUDE = 1, 2, 3, 4
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def jpeg_segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, payload) of the segments before the scan."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
        elif marker in (0xD9, 0xDA):
            return
        else:
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            yield marker, data[at + 4 : at + 2 + size]
            at += 2 + size


class Fields:
    """The fields of one directory of a TIFF block by tag; damaged ones are left out."""

    def __init__(self, block: bytes, at: int, order: str):
        self.block, self.order, self.at = block, order, {}
        if at + 2 <= len(block):
            for k in range(struct.unpack_from(order + "H", block, at)[0]):
                place = at + 2 + 12 * k
                if place + 12 <= len(block):
                    tag, kind, count = struct.unpack_from(order + "HHI", block, place)
                    size = FIELD_BYTES.get(kind, 0) * count
                    start = place + 8 if size <= 4 else struct.unpack_from(order + "I", block, place + 8)[0]
                    if size and start + size <= len(block):
                        self.at[tag] = (kind, count, start)

    def number(self, tag: int) -> int | None:
        kind, _, start = self.at.get(tag, (0, 0, 0))
        return struct.unpack_from(self.order + {3: "H", 4: "I"}[kind], self.block, start)[0] if kind in (3, 4) else None

    def text(self, tag: int) -> str:
        kind, count, start = self.at.get(tag, (0, 0, 0))
        return self.block[start : start + count].split(b"\0")[0].decode("ascii", "replace") if kind == 2 else ""

    def degrees(self, tag: int, ref: int, negative: str) -> float | None:
        kind, count, start = self.at.get(tag, (0, 0, 0))
        if kind != 5 or count < 3:
            return None
        parts = struct.unpack_from(self.order + "6I", self.block, start)
        if not all(parts[1::2]):
            return None
        value = parts[0] / parts[1] + parts[2] / parts[3] / 60 + parts[4] / parts[5] / 3600
        return -value if self.text(ref) == negative else value


def exif(data: bytes) -> tuple[int, bool, float | None, float | None]:
    """(orientation, has a place, latitude, longitude) of a JPEG; 1 and nothing where it tells nothing."""
    block = next((p[6:] for m, p in jpeg_segments(data) if m == 0xE1 and p.startswith(b"Exif\0\0")), b"")
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    if order is None or len(block) < 8:
        return 1, False, None, None
    fields = Fields(block, struct.unpack_from(order + "I", block, 4)[0], order)
    turned = fields.number(ORIENTATION)
    pointer = fields.number(GPS)
    place = Fields(block, pointer, order) if pointer is not None else None
    turned = turned if turned is not None and 1 <= turned <= 8 else 1
    if place is None or not place.at:
        return turned, False, None, None
    return turned, True, place.degrees(LATITUDE, LATITUDE_REF, "S"), place.degrees(LONGITUDE, LONGITUDE_REF, "W")


def details(mime: str, data: bytes) -> tuple:
    """(width, height, bit depth, colour, alpha, orientation, privacy, latitude, longitude, malformed)."""
    size, depth, colour, alpha = None, None, "unknown", False
    turned, placed, latitude, longitude = 1, False, None, None
    if mime == "image/png" and len(data) >= 26:
        size, depth, colour = struct.unpack_from(">II", data, 16), data[24], PNG_COLOURS.get(data[25], "unknown")
        alpha = data[25] in (4, 6) or (data[25] == 3 and b"tRNS" in data)
    elif mime == "image/gif" and len(data) >= 11:
        size, colour, alpha = struct.unpack_from("<HH", data, 6), "palette", b"\x21\xf9" in data
        depth = (data[10] & 7) + 1 if data[10] & 0x80 else None
    elif mime == "image/bmp" and len(data) >= 30:
        width, height = struct.unpack_from("<ii", data, 18)
        size, depth = (width, abs(height)), struct.unpack_from("<H", data, 28)[0]
        alpha = depth == 32
        colour = "rgba" if alpha else "rgb" if depth >= 24 else "palette"
    elif mime == "image/jpeg":
        size = jpeg_size(data)
        frame = next((p for m, p in jpeg_segments(data) if 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC) and len(p) >= 6), None)
        if frame:
            depth, colour = frame[0], JPEG_COLOURS.get(frame[5], "unknown")
        turned, placed, latitude, longitude = exif(data)
    malformed = (size is None and mime != "image/jpeg") or (size is not None and min(size) <= 0)
    return (*(size or (None, None)), depth, colour, alpha, turned, "location" if placed else "none", latitude, longitude, malformed)


_DETAILS = "path string, media_type string, width bigint, height bigint, bit_depth int, colour string, has_alpha boolean, orientation int, privacy string, latitude double, longitude double, malformed boolean"


def image_details(files: DataFrame, with_place: bool = False) -> DataFrame:
    """The details of the images among ``path, content``, one row an image; the type is told by the first bytes.

    ``privacy`` is ``location`` where an image tells its place; the place itself comes out only if asked for.
    """
    images = files.select("path", media_type(F.col("content")).alias("m"), "content").where(F.col("m").isin("image/png", "image/gif", "image/bmp", "image/jpeg"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, mime, content in zip(batch["path"], batch["m"], batch["content"]):
                row = details(mime, bytes(content))
                out.append((path, mime, *(row if with_place else (*row[:7], None, None, row[9]))))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _DETAILS.split(", ")], dtype=object)

    return images.mapInPandas(run, _DETAILS)
