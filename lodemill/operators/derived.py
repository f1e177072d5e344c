"""Derived media: transcripts, regions, scenes, payloads and plans as columns and tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemill.functions.text import glob_regex

# What is said of a segment without a transcript.
SEGMENT_DETAIL = {
    "silence": "silence, no speech detected",
    "music": "non-speech audio (music) detected",
    "unrecognized": "speech present but not recognized",
    "unsupported_language": "speech in an unsupported language",
}


def segment_rows(segments: DataFrame) -> DataFrame:
    """Each segment as a representation: ``segment_id, status, complete, fraction, detail, payload, confidence``.

    ``segments(segment_id, kind, text, speaker, language, confidence)``. Silence and music are known to hold no speech;
    other kinds without a transcript are partial. Only speech has a confidence; a null text stays null.
    """
    kind = F.col("kind")
    known = kind.isin("speech", "silence", "music")
    payload = F.when((F.coalesce(F.col("speaker"), F.lit("")) != "") & (F.coalesce(F.col("text"), F.lit("")) != ""), F.concat(F.lit("["), "speaker", F.lit("] "), "text")).otherwise(F.col("text"))
    said = F.create_map(*[F.lit(x) for pair in SEGMENT_DETAIL.items() for x in pair])
    language = F.when(F.coalesce(F.col("language"), F.lit("")) != "", F.concat(F.lit(" ("), "language", F.lit(")"))).otherwise("")
    detail = F.when(kind == "speech", "speech").otherwise(F.concat(F.try_element_at(said, kind), language))
    return segments.select("segment_id", F.when(known, "current").otherwise("partial").alias("status"), known.alias("complete"), known.cast("double").alias("fraction"), detail.alias("detail"), payload.alias("payload"), F.when(kind == "speech", F.col("confidence")).alias("confidence"))


def regions(json: Column) -> Column:
    """The regions of a recogniser's JSON as ``array<struct<text, bbox, confidence>>``; entries without text or four numbers are skipped."""
    raw = F.from_json(json, "struct<regions:array<string>>")["regions"]
    parsed = F.transform(raw, lambda r: F.from_json(r, "struct<text:string,bbox:array<double>,confidence:double>"))
    return F.filter(parsed, lambda r: r["text"].isNotNull() & (F.coalesce(F.size(r["bbox"]), F.lit(0)) == 4) & F.forall(r["bbox"], lambda x: x.isNotNull()))


def recognition_confidence(json: Column) -> Column:
    """The overall confidence if told, else the mean of the regions' own, else null."""
    overall = F.from_json(json, "struct<confidence:double>")["confidence"]
    own = F.filter(F.transform(regions(json), lambda r: r["confidence"]), lambda x: x.isNotNull())
    return F.coalesce(overall, F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda a, b: a + b) / F.size(own)))


def visual_payload(json: Column) -> Column:
    """``struct<space, vector>`` of an embedding's payload; null unless it has a space's name and numbers only."""
    parsed = F.from_json(json, "struct<space:string,embedding:array<double>>")
    fits = (F.coalesce(parsed["space"], F.lit("")) != "") & (F.coalesce(F.size(parsed["embedding"]), F.lit(0)) > 0) & F.forall(parsed["embedding"], lambda x: x.isNotNull())
    return F.when(fits, F.struct(parsed["space"].alias("space"), parsed["embedding"].alias("vector")))


_TYPES = {"string": "^STRING$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT"}


def contract_fault(json: Column, required: list[str], types: dict[str, str]) -> Column:
    """What a JSON text breaks first of a contract, null if nothing: ``no object``, ``missing: a, b`` or ``type: key``.

    ``types`` names a key's type: string, number, boolean, array or object; keys that are not there have none.
    """
    parsed = F.try_parse_json(json)
    keys = F.coalesce(F.json_object_keys(json), F.array())
    absent = F.array_sort(F.array_except(F.array(*map(F.lit, required)), keys)) if required else F.array().cast("array<string>")
    wrong = [F.when(F.array_contains(keys, key) & ~F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, f"$.{key}", "variant")).rlike(_TYPES[kind]), F.lit(False)), f"type: {key}") for key, kind in types.items()]
    fault = F.when(~F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)), "no object").when(F.size(absent) > 0, F.concat(F.lit("missing: "), F.array_join(absent, ", ")))
    return F.coalesce(fault, *wrong) if wrong else fault


def scenes_with_keyframes(scenes: DataFrame, keyframes: DataFrame) -> DataFrame:
    """``video_id, scene, keyframe_id, fraction`` of ``scenes(video_id, scene, at_ms)``: the keyframe at the scene's time, if there is one.

    Of several keyframes at a time the largest id holds. The fraction is 1 only for a keyframe whose status is current.
    """
    at = keyframes.groupBy("video_id", "at_ms").agg(F.max(F.struct("keyframe_id", "status")).alias("k"))
    both = scenes.join(at, ["video_id", "at_ms"], "left")
    return both.select("video_id", "scene", "k.keyframe_id", F.coalesce((F.col("k.status") == "current").cast("double"), F.lit(0.0)).alias("fraction"))


@dataclass(frozen=True)
class CoverageBudget:
    """What sampling a video may cost."""

    least_gap_ms: int = 2_000
    most_gap_ms: int = 15_000
    keyframes: int = 200
    pixels: int = 200_000_000
    bytes: int = 20_000_000
    keyframe_bytes: int = 150_000
    seconds: float = 120.0
    scan_seconds_per_ms: float = 0.00002
    keyframe_seconds: float = 0.5
    least_keyframes: int = 3
    duration_ms: int = 1_800_000
    hard_duration_ms: int = 7_200_000
    escalation: int = 3
    gpu_pixels: int = 8_000_000
    gpu: bool = False
    approval: bool = True


def coverage_plans(videos: DataFrame, budget: CoverageBudget = CoverageBudget()) -> DataFrame:
    """How a video is sampled within a budget: ``video_id, policy, keyframes, gap_ms, fraction, reasons``.

    ``videos(video_id, duration_ms, width, height, encrypted, malformed)``. The policy is ``sampled``, ``ask`` (the owner)
    or ``unavailable``; the last two have one reason and no keyframes. Keyframes are the least of what the gap, the number,
    the pixels, the bytes and the time allow; each limit that cuts them is a reason.
    """
    b = budget
    refuse = F.lit("ask" if b.approval else "unavailable")
    rows = videos.select("video_id", "duration_ms", "width", "height", (F.col("width") * F.col("height")).alias("area"), F.coalesce("encrypted", F.lit(False)).alias("locked"), F.coalesce("malformed", F.lit(False)).alias("broken"))
    rows = rows.withColumn("wanted", F.greatest(F.lit(1), F.ceil(F.col("duration_ms") / b.least_gap_ms)))
    rows = rows.withColumn("desired", F.least(F.col("wanted"), F.lit(b.keyframes)))
    rows = rows.withColumn("by_pixels", F.when(F.col("area") > 0, F.floor(F.lit(b.pixels) / F.col("area"))))
    rows = rows.withColumn("k1", F.greatest(F.lit(0), F.least("desired", "by_pixels")))
    by_bytes = b.bytes // b.keyframe_bytes
    rows = rows.withColumn("k2", F.least("k1", F.lit(by_bytes)))
    rows = rows.withColumn("scan", F.col("duration_ms") * F.lit(b.scan_seconds_per_ms))
    late = F.col("scan") + F.col("k2") * F.lit(b.keyframe_seconds) > b.seconds
    rows = rows.withColumn("late", late).withColumn("k3", F.when(F.col("late"), F.greatest(F.lit(0), F.least("k2", F.floor((F.lit(b.seconds) - F.col("scan")) / b.keyframe_seconds)))).otherwise(F.col("k2")))
    stop = (
        F.when(F.coalesce("duration_ms", F.lit(0)) <= 0, F.struct(F.lit("unavailable"), F.lit("duration")))
        .when((F.coalesce("width", F.lit(0)) == 0) | (F.coalesce("height", F.lit(0)) == 0), F.struct(F.lit("unavailable"), F.lit("dimensions")))
        .when(F.col("locked"), F.struct(F.lit("unavailable"), F.lit("encrypted")))
        .when(F.col("broken"), F.struct(F.lit("unavailable"), F.lit("malformed")))
        .when((F.col("area") >= b.gpu_pixels) & F.lit(not b.gpu), F.struct(refuse, F.lit("compute class")))
        .when(F.col("duration_ms") > b.hard_duration_ms, F.struct(F.lit("unavailable"), F.lit("hard duration")))
        .when(F.col("duration_ms") > b.duration_ms * b.escalation, F.struct(F.lit("unavailable"), F.lit("duration budget")))
        .when(F.col("duration_ms") > b.duration_ms, F.struct(refuse, F.lit("duration budget")))
        .when(F.col("scan") > b.seconds, F.struct(refuse, F.lit("scan time")))
        .when(F.col("k3") < b.least_keyframes, F.struct(refuse, F.lit("no viable keyframes")))
    )
    cuts = F.array_compact(F.array(F.when(F.col("desired") < F.col("wanted"), "keyframes"), F.when(F.col("by_pixels") < F.col("desired"), "pixels"), F.when(F.lit(by_bytes) < F.col("k1"), "bytes"), F.when(F.col("late"), "time")))
    rows = rows.withColumn("stop", stop).withColumn("cuts", cuts)
    kept = F.col("stop").isNull()
    gap = F.greatest(F.lit(b.least_gap_ms), F.least(F.lit(b.most_gap_ms), F.floor(F.col("duration_ms") / F.nullif(F.col("k3"), F.lit(0)))))
    share = F.when((F.col("k3") >= F.col("desired")) & (F.size("cuts") == 0), 1.0).otherwise(F.least(F.bround(F.col("k3") / F.col("desired"), 4), F.lit(0.9999)))
    return rows.select("video_id", F.coalesce(F.col("stop")["col1"], F.lit("sampled")).alias("policy"), F.when(kept, F.col("k3")).cast("bigint").alias("keyframes"), F.when(kept, gap).cast("bigint").alias("gap_ms"), F.when(kept, share).otherwise(0.0).alias("fraction"), F.when(kept, F.col("cuts")).otherwise(F.array(F.col("stop")["col2"])).alias("reasons"))


def accepted_types(mime: Column, patterns: list[tuple[str, str | None]], available: set[str]) -> Column:
    """Whether a media type fits an enabled pattern whose pipeline, if it needs one, is available."""
    hit = F.lit(False)
    for pattern, pipeline in patterns:
        if pipeline is None or pipeline in available:
            hit = hit | mime.rlike(glob_regex(pattern))
    return F.coalesce(hit, F.lit(False))


def best_match_mean(pairs: DataFrame) -> DataFrame:
    """``id, score``: the mean over a page's true boxes of the best overlap any found box has with it.

    ``pairs(id, truth, found)`` holds the two lists of boxes of each page; a page without true boxes has 1 if nothing was
    found, else 0.
    """
    area = lambda x: F.greatest(F.lit(0.0), x[2] - x[0]) * F.greatest(F.lit(0.0), x[3] - x[1])

    def overlap(x: Column, y: Column) -> Column:
        both = F.greatest(F.lit(0.0), F.least(x[2], y[2]) - F.greatest(x[0], y[0])) * F.greatest(F.lit(0.0), F.least(x[3], y[3]) - F.greatest(x[1], y[1]))
        return F.coalesce(F.try_divide(both, area(x) + area(y) - both), F.lit(0.0))

    best = F.transform("truth", lambda t: F.coalesce(F.array_max(F.transform(F.col("found"), lambda f: overlap(t, f))), F.lit(0.0)))
    mean = F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size("truth")
    return pairs.select("id", F.when(F.size("truth") == 0, (F.size("found") == 0).cast("double")).otherwise(mean).alias("score"))


def understanding(documents: DataFrame, pages: DataFrame, least_chars: int = 20, share: float = 0.5) -> DataFrame:
    """``id, native, image_pages, outcome`` of ``documents(id, text, page_count, encrypted)`` with ``pages(id, page, text)``.

    Native text stands if there is any. Pages with little text, those without a row included, are image pages; they need a
    recogniser: ``ocr``. The outcome is ``unavailable`` for encrypted documents, ``native`` if no page is an image, and
    ``unknown`` pages leave the native text alone.
    """
    rich = pages.where(F.length(F.trim("text")) >= least_chars).groupBy("id").agg(F.collect_set("page").alias("rich"))
    both = documents.join(rich, "id", "left")
    numbers = F.when(F.coalesce("page_count", F.lit(0)) > 0, F.sequence(F.lit(1), F.col("page_count"))).otherwise(F.array().cast("array<int>"))
    image = F.array_sort(F.array_except(numbers, F.coalesce("rich", F.array().cast("array<int>"))))
    native = F.coalesce(F.trim("text"), F.lit("")) != ""
    outcome = F.when(F.col("encrypted"), "unavailable").when(F.size(image) == 0, "native").when(F.size(image) > share * F.col("page_count"), "ocr").otherwise("hybrid")
    return both.select("id", native.alias("native"), F.when(~F.col("encrypted"), image).alias("image_pages"), outcome.alias("outcome"))


def descriptor_rows(described: DataFrame) -> DataFrame:
    """``path, status, error, fraction``: what reconciliation records of described files; nothing is run on them.

    Encrypted files, and those whose type is unknown, are unavailable.
    """
    lost = F.col("encrypted") | F.col("media_type").isNull()
    return described.select("path", F.when(lost, "unavailable").otherwise("current").alias("status"), F.when(F.col("encrypted"), "encrypted").when(lost, "unsupported or malformed").alias("error"), F.when(lost, 0.0).otherwise(1.0).alias("fraction"))
