"""Media: headers built from the files table and read again, reports, plans and what is derived from them."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemill.operators import derived, images, media, records
from lodemill.plans.binding import LATEST_FILES
from lodemill.session import table


def _hex(value, digits: int, little: bool = False) -> Column:
    text = F.lpad(F.hex(value.cast("bigint")), digits, "0")
    return F.concat(*[F.substring(text, k, 2) for k in range(digits - 1, 0, -2)]) if little else text


def _office() -> str:
    """A small Office file; its bytes are the same each time."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in ("[Content_Types].xml", "word/document.xml"):
            z.writestr(zipfile.ZipInfo(name), "x")
    return out.getvalue().hex()


def _sample(spark, sf_dir) -> DataFrame:
    """``id, s, n``: each file with a number and the kind of content it gets, both from its size."""
    files = records.latest_files(table(spark, sf_dir, "files"), [])
    s = F.coalesce("size_bytes", F.lit(0))
    return files.select("id", s.alias("s"), (s % 9).alias("n"))


def _contents(spark, sf_dir) -> DataFrame:
    """``path, content``: each file with a small content of a format. One in four has the suffix of another format."""
    s, n = F.col("s"), F.col("n")
    w, h = s % 4000 + 1, s % 3000 + 2
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _hex(w, 8), _hex(h, 8), F.lit("08"), F.when(s % 2 == 0, "06").otherwise("02"), F.lit("000000"))
    gif = F.concat(F.lit("474946383961"), _hex(w, 4, True), _hex(h, 4, True), F.when(s % 2 == 0, "F7").otherwise("00"), F.lit("0000"))
    bmp = F.concat(F.lit("424D"), F.lit("00" * 16), _hex(w, 8, True), F.when(s % 2 == 0, _hex(h, 8, True)).otherwise(_hex(F.lit(2**32) - h, 8, True)), F.lit("0100"), F.when(s % 2 == 0, "2000").otherwise("1800"), F.lit("00" * 8))
    turned = F.concat(F.lit("011200030000000100"), _hex(s % 8 + 1, 2), F.lit("0000"))
    plain = F.concat(F.lit("FFE100224578696600004D4D002A000000080001"), turned, F.lit("00000000"))
    degrees = F.concat(_hex(s % 90, 8), F.lit("000000010000001E000000010000000000000001"))
    placed = F.concat(F.lit("FFE100644578696600004D4D002A000000080002"), turned, F.lit("88250004000000010000002600000000"), F.lit("0002"), F.lit("0001000200000002"), F.when(s % 2 == 0, "53000000").otherwise("4E000000"), F.lit("000200050000000300000044"), F.lit("00000000"), degrees)
    jpeg = F.concat(F.lit("FFD8"), F.when(s % 3 == 0, placed).otherwise(plain), F.lit("FFC0001108"), _hex(h, 4), _hex(w, 4), F.lit("03012200021101031101FFD9"))
    held = s % 200
    wav = F.concat(F.lit("52494646FFFFFFFF57415645666D7420100000000100010008000000080000000100"), F.lit("0800"), F.lit("64617461"), _hex(held + F.when(s % 2 == 0, 0).otherwise(1000), 8, True), F.repeat(F.lit("7F"), held.cast("int")))
    pdf = F.concat(F.hex(F.lit("%PDF-1.4 ")), F.repeat(F.hex(F.lit("<< /Type /Page >> ")), (s % 5 + 1).cast("int")), F.when(s % 3 == 0, F.hex(F.lit("/Encrypt"))).otherwise(""))
    mp4 = F.concat(F.lit("0000001866747970"), F.when(s % 3 == 0, F.hex(F.lit("M4A "))).when(s % 3 == 1, F.hex(F.lit("qt  "))).otherwise(F.hex(F.lit("isom"))), F.lit("00000000"))
    known = [("png", png), ("gif", gif), ("bmp", bmp), ("jpg", jpeg), ("wav", wav), ("pdf", pdf), ("mp4", mp4), ("docx", F.lit(_office())), ("bin", F.hex(F.lit("nothing known")))]
    content, suffix = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (name, body) in reversed(list(enumerate(known))):
        content, suffix = F.when(n == k, body).otherwise(content), F.when(n == k, F.lit(name)).otherwise(suffix)
    path = F.concat("id", F.lit("."), F.when(s % 4 == 0, "png").otherwise(suffix))
    return _sample(spark, sf_dir).select(path.alias("path"), F.unhex(content).alias("content"))


def media_descriptions(spark, sf_dir) -> DataFrame:
    return media.describe(_contents(spark, sf_dir))


def image_details(spark, sf_dir) -> DataFrame:
    rows = images.image_details(_contents(spark, sf_dir), with_place=True)
    return rows.select("path", "media_type", "width", "height", "bit_depth", "colour", "has_alpha", "orientation", "privacy", F.round("latitude", 6).alias("latitude"), "malformed")


def media_descriptors(spark, sf_dir) -> DataFrame:
    return derived.descriptor_rows(media_descriptions(spark, sf_dir))


def probe_reports(spark, sf_dir) -> DataFrame:
    """A probe's JSON for each order, read again: a video stream, or for one in five an audio stream only."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("codec"))
    seconds = F.concat((F.col("o_orderkey") % 900).cast("string"), F.lit(".25"))
    video = F.format_string('{"codec_type":"video","codec_name":"%s","width":%d,"height":%d%s,"avg_frame_rate":"%s","r_frame_rate":"30/1"},', F.col("codec"), F.col("o_custkey") % 1920 + 16, F.col("o_custkey") % 1080 + 16, F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(',"duration":"'), seconds, F.lit('"'))).otherwise(""), F.when(F.col("o_orderkey") % 3 == 0, "24000/1001").otherwise("30/1"))
    json = F.concat(F.lit('{"streams":['), F.when(F.col("o_orderkey") % 5 != 0, video).otherwise(""), F.lit('{"codec_type":"audio","codec_name":"aac"}],"format":{"duration":"7.5"}}'))
    read = o.select("o_orderkey", media.probe_report(json).alias("r")).select("o_orderkey", "r.*")
    return read.withColumn("frame_rate", F.round("frame_rate", 4))


def segment_representations(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, ("speech", "silence", "music", "unrecognized", "unsupported_language"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    rows = line.select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(F.col("l_extendedprice") * 100 + 0.5)).alias("segment_id"), kind.alias("kind"), F.when(kind == "speech", F.concat(F.lit("part "), "l_partkey")).otherwise("").alias("text"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("SPEAKER_"), F.col("l_suppkey") % 3)).alias("speaker"), F.when(F.col("l_returnflag") == "R", "xx").alias("language"), (F.col("l_quantity") / 64).alias("confidence"))
    return derived.segment_rows(rows)


def _recognised(spark, sf_dir) -> DataFrame:
    """``id, json``: a recogniser's answer for each order, a region for each quantity of its lines, some of them malformed."""
    box = F.when(F.col("q") % 7 == 0, "[1,2,3]").when(F.col("q") % 5 == 0, "null").otherwise(F.concat(F.lit("[0,0,"), "q", F.lit(",10]")))
    region = F.when(F.col("q") % 11 == 0, "17").otherwise(F.concat(F.when(F.col("q") % 6 == 0, "{").otherwise(F.concat(F.lit('{"text":"w'), "q", F.lit('",'))), F.lit('"bbox":'), box, F.when(F.col("q") % 4 == 0, "}").otherwise(F.concat(F.lit(',"confidence":'), (F.col("q") / 64).cast("string"), F.lit("}")))))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").cast("int").alias("q")).distinct().select("id", "q", region.alias("region"))
    each = lines.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("q", "region"))), lambda x: x["region"]), ",").alias("all"), F.max("q").alias("q"))
    return each.select("id", F.concat(F.lit("{"), F.when(F.col("q") % 3 == 0, '"confidence":0.5,').otherwise(""), F.lit('"regions":['), "all", F.lit("]}")).alias("json"))


def recognised_regions(spark, sf_dir) -> DataFrame:
    found = _recognised(spark, sf_dir).select("id", derived.regions(F.col("json")).alias("r"), derived.recognition_confidence(F.col("json")).alias("c"))
    return found.select("id", F.size("r").alias("regions"), F.array_join(F.transform("r", lambda x: x["text"]), " ").alias("text"), F.round("c", 6).alias("confidence"))


def box_matches(spark, sf_dir) -> DataFrame:
    """The boxes of an order's lines against those of the same lines moved by their line number."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", F.col("l_quantity").cast("double").alias("q"), "l_returnflag").distinct()
    box = lambda by: F.array(by, F.lit(0.0), F.col("q") + by, F.lit(10.0))
    none = F.lit(0.0)
    both = lines.groupBy("id").agg(F.collect_set(box(none)).alias("truth"), F.collect_set(F.when(F.col("l_returnflag") != "R", box(F.col("l_linenumber").cast("double")))).alias("found"))
    return derived.best_match_mean(both).select("id", F.round("score", 12).alias("score"))


def visual_payloads(spark, sf_dir) -> DataFrame:
    """Payloads of embeddings, three in seven of them broken, as their space and dimension."""
    v = F.col("vec_id")
    numbers = F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double"), 3).cast("decimal(9,3)").cast("string")), ",")
    numbers = F.when(v % 7 == 1, F.concat(numbers, F.lit(',"x"'))).when(v % 7 == 2, "").otherwise(numbers)
    json = F.concat(F.lit('{"space":"'), F.when(v % 7 == 3, "").otherwise(F.concat(F.lit("space"), F.col("label") % 3)), F.lit('","embedding":['), numbers, F.lit("]}"))
    return table(spark, sf_dir, "embeddings").select("vec_id", derived.visual_payload(json).alias("p")).where(F.col("p").isNotNull()).select("vec_id", "p.space", F.size("p.vector").alias("dimension"), (F.round(F.col("p.vector")[0], 3) + 0.0).alias("first"))


def contract_faults(spark, sf_dir) -> DataFrame:
    """Answers about orders against a contract: an object with a name and a list, whose count is a number if there."""
    k = F.col("o_orderkey")
    json = F.when(k % 9 == 0, "[1, 2]").when(k % 9 == 1, "{broken").when(k % 9 == 2, '{"name": "a"}').when(k % 9 == 3, '{"count": 3}').when(k % 9 == 4, '{"name": 5, "tags": []}').when(k % 9 == 5, '{"name": "a", "tags": {}}').when(k % 9 == 6, '{"name": "a", "tags": ["x"], "count": "3"}').when(k % 9 == 7, '{"name": "a", "tags": ["x"], "count": 3.5}').otherwise('{"name": "a", "tags": []}')
    return table(spark, sf_dir, "orders").select(k.alias("id"), derived.contract_fault(json, ["name", "tags"], {"name": "string", "tags": "array", "count": "number"}).alias("fault"))


def scene_keyframes(spark, sf_dir) -> DataFrame:
    """Clicks as scenes of their user, views as keyframes, both at the whole part of their value."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("video_id"), F.floor("value").cast("bigint").alias("at_ms"), "event_type", F.when(F.col("value") - F.floor("value") < 0.75, "current").otherwise("failed").alias("status"))
    frames = rows.where(F.col("event_type") == "view").select("video_id", "at_ms", F.col("event_id").alias("keyframe_id"), "status")
    return derived.scenes_with_keyframes(rows.where(F.col("event_type") == "click").select("video_id", F.col("event_id").alias("scene"), "at_ms"), frames)


def video_coverage(spark, sf_dir) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    videos = table(spark, sf_dir, "orders").select(k.alias("video_id"), ((k * 7919) % 9_000_000 - 1000).alias("duration_ms"), F.when(c % 17 != 0, c % 1200 * 3).alias("width"), (c % 900 * 3).alias("height"), (k % 23 == 0).alias("encrypted"), (k % 29 == 0).alias("malformed"))
    return derived.coverage_plans(videos).withColumn("reasons", F.array_join("reasons", ", "))


def accepted_media(spark, sf_dir) -> DataFrame:
    patterns = [("image/*", None), ("audio/*", "speech"), ("application/pdf", "pages"), ("text/m?rkdown", "pages")]
    files = records.latest_files(table(spark, sf_dir, "files"), ["mime"])
    return files.where(derived.accepted_types(F.col("mime"), patterns, {"pages"})).select("id", "mime")


def document_understanding(spark, sf_dir) -> DataFrame:
    """Orders as documents of seven pages, their lines as pages; a page's text is as long as its quantity."""
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("page"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("text"))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", "text").alias("text"), (F.col("o_custkey") % 8).cast("int").alias("page_count"), (F.col("o_orderkey") % 11 == 0).alias("encrypted"))
    return derived.understanding(docs, pages).withColumn("image_pages", F.array_join("image_pages", ","))


_KINDS = f"""WITH {LATEST_FILES},
s AS (SELECT id, coalesce(size_bytes, 0) AS s, coalesce(size_bytes, 0) % 9 AS n FROM latest_files),
k AS (SELECT *, id || '.' || CASE WHEN s % 4 = 0 THEN 'png' ELSE ['png', 'gif', 'bmp', 'jpg', 'wav', 'pdf', 'mp4', 'docx', 'bin'][n + 1] END AS path,
  ['image/png', 'image/gif', 'image/bmp', 'image/jpeg', 'audio/wav', 'application/pdf', ['audio/mp4', 'video/quicktime', 'video/mp4'][s % 3 + 1],
   'application/vnd.openxmlformats-officedocument.wordprocessingml.document', NULL][n + 1] AS media_type FROM s)"""
_DESCRIPTIONS = f"""{_KINDS}
SELECT path, media_type, CASE WHEN n < 4 THEN s % 4000 + 1 END AS width, CASE WHEN n < 4 THEN s % 3000 + 2 END AS height, CASE WHEN n = 4 THEN (s % 200) * 125 END AS duration_ms,
  CASE WHEN n = 5 THEN (s % 5 + 1)::int END AS pages, n = 5 AND s % 3 = 0 AS encrypted,
  coalesce(media_type <> CASE WHEN s % 4 = 0 THEN 'image/png' WHEN n = 6 THEN 'video/mp4' WHEN n < 8 THEN media_type END, false) AS mismatch FROM k"""
_COVERAGE = """WITH v AS (SELECT o_orderkey AS video_id, (o_orderkey * 7919) % 9000000 - 1000 AS d, CASE WHEN o_custkey % 17 <> 0 THEN o_custkey % 1200 * 3 END AS w, o_custkey % 900 * 3 AS h, o_orderkey % 23 = 0 AS e, o_orderkey % 29 = 0 AS m FROM orders),
a AS (SELECT *, w * h AS area, greatest(1, ceil(d / 2000.0::double)::bigint) AS wanted, least(greatest(1, ceil(d / 2000.0::double)::bigint), 200) AS desired, d * 0.00002::double AS scan FROM v),
b AS (SELECT *, CASE WHEN area > 0 THEN 200000000 // area END AS px, greatest(0, least(desired, CASE WHEN area > 0 THEN 200000000 // area ELSE desired END)) AS k1 FROM a),
c AS (SELECT *, least(k1, 133) AS k2, scan + least(k1, 133) * 0.5::double > 120 AS late FROM b),
f AS (SELECT *, CASE WHEN late THEN greatest(0, least(k2, floor((120 - scan) / 0.5::double)::bigint)) ELSE k2 END AS k3 FROM c),
g AS (SELECT *, CASE WHEN d <= 0 THEN ['unavailable', 'duration'] WHEN coalesce(w, 0) = 0 OR coalesce(h, 0) = 0 THEN ['unavailable', 'dimensions'] WHEN e THEN ['unavailable', 'encrypted'] WHEN m THEN ['unavailable', 'malformed']
    WHEN area >= 8000000 THEN ['ask', 'compute class'] WHEN d > 7200000 THEN ['unavailable', 'hard duration'] WHEN d > 5400000 THEN ['unavailable', 'duration budget'] WHEN d > 1800000 THEN ['ask', 'duration budget']
    WHEN scan > 120 THEN ['ask', 'scan time'] WHEN k3 < 3 THEN ['ask', 'no viable keyframes'] END AS stop,
  list_filter([CASE WHEN desired < wanted THEN 'keyframes' END, CASE WHEN px < desired THEN 'pixels' END, CASE WHEN 133 < k1 THEN 'bytes' END, CASE WHEN late THEN 'time' END], lambda x: x IS NOT NULL) AS cuts FROM f)
SELECT video_id, coalesce(stop[1], 'sampled') AS policy, CASE WHEN stop IS NULL THEN k3 END AS keyframes, CASE WHEN stop IS NULL THEN greatest(2000, least(15000, d // nullif(k3, 0))) END AS gap_ms,
  CASE WHEN stop IS NOT NULL THEN 0.0 WHEN k3 >= desired AND len(cuts) = 0 THEN 1.0 ELSE least(round_even(k3::double / desired, 4), 0.9999::double) END AS fraction,
  CASE WHEN stop IS NULL THEN array_to_string(cuts, ', ') ELSE stop[2] END AS reasons FROM g"""

QUERIES = {
    f.__name__: f
    for f in (
        media_descriptions, image_details, media_descriptors, probe_reports, segment_representations, recognised_regions, box_matches, visual_payloads, contract_faults, scene_keyframes, video_coverage,
        accepted_media, document_understanding,
    )
}
SQL = {
    "media_descriptions": _DESCRIPTIONS,
    "image_details": f"""{_KINDS}
      SELECT path, media_type, s % 4000 + 1 AS width, s % 3000 + 2 AS height,
        CASE n WHEN 0 THEN 8 WHEN 1 THEN CASE WHEN s % 2 = 0 THEN 8 END WHEN 2 THEN CASE WHEN s % 2 = 0 THEN 32 ELSE 24 END ELSE 8 END AS bit_depth,
        CASE n WHEN 1 THEN 'palette' WHEN 3 THEN 'ycbcr' ELSE CASE WHEN s % 2 = 0 THEN 'rgba' ELSE 'rgb' END END AS colour, n IN (0, 2) AND s % 2 = 0 AS has_alpha,
        CASE WHEN n = 3 THEN (s % 8 + 1)::int ELSE 1 END AS orientation, CASE WHEN n = 3 AND s % 3 = 0 THEN 'location' ELSE 'none' END AS privacy,
        CASE WHEN n = 3 AND s % 3 = 0 THEN CASE WHEN s % 2 = 0 THEN -1 ELSE 1 END * (s % 90 + 0.5::double) END AS latitude, false AS malformed FROM k WHERE n < 4""",
    "media_descriptors": f"""WITH d AS ({_DESCRIPTIONS})
      SELECT path, CASE WHEN encrypted OR media_type IS NULL THEN 'unavailable' ELSE 'current' END AS status, CASE WHEN encrypted THEN 'encrypted' WHEN media_type IS NULL THEN 'unsupported or malformed' END AS error,
        CASE WHEN encrypted OR media_type IS NULL THEN 0.0 ELSE 1.0 END::double AS fraction FROM d""",
    "probe_reports": """WITH v AS (SELECT o_orderkey, o_orderkey % 5 <> 0 AS video, o_orderkey AS k, o_custkey AS c, o_orderstatus AS s FROM orders)
      SELECT o_orderkey, CASE WHEN video THEN s END AS codec, CASE WHEN video THEN (c % 1920 + 16)::int END AS width, CASE WHEN video THEN (c % 1080 + 16)::int END AS height,
        CASE WHEN video THEN CASE WHEN k % 2 = 0 THEN (k % 900) * 1000 + 250 ELSE 7500 END END AS duration_ms, CASE WHEN video THEN round(CASE WHEN k % 3 = 0 THEN 24000.0::double / 1001 ELSE 30.0::double END, 4) END AS frame_rate,
        CASE WHEN video THEN k % 3 = 0 END AS variable_rate, CASE WHEN video THEN true END AS has_audio FROM v""",
    "segment_representations": """WITH l AS (SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || floor(l_extendedprice * 100 + 0.5::double)::bigint AS segment_id, l_partkey % 5 AS n, l_partkey, l_suppkey, l_returnflag, l_quantity FROM lineitem)
      SELECT segment_id, CASE WHEN n < 3 THEN 'current' ELSE 'partial' END AS status, n < 3 AS complete, CASE WHEN n < 3 THEN 1.0 ELSE 0.0 END::double AS fraction,
        CASE WHEN n = 0 THEN 'speech' ELSE ['silence, no speech detected', 'non-speech audio (music) detected', 'speech present but not recognized', 'speech in an unsupported language'][n] || CASE WHEN l_returnflag = 'R' THEN ' (xx)' ELSE '' END END AS detail,
        CASE WHEN n = 0 THEN CASE WHEN l_suppkey % 2 = 0 THEN '[SPEAKER_' || (l_suppkey % 3) || '] ' ELSE '' END || 'part ' || l_partkey ELSE '' END AS payload, CASE WHEN n = 0 THEN l_quantity / 64 END AS confidence FROM l""",
    "recognised_regions": """WITH l AS (SELECT DISTINCT l_orderkey AS id, l_quantity::int AS q FROM lineitem),
      g AS (SELECT *, q % 11 <> 0 AND q % 7 <> 0 AND q % 5 <> 0 AND q % 6 <> 0 AS fits FROM l)
      SELECT id, count_if(fits)::int AS regions, coalesce(string_agg('w' || q, ' ' ORDER BY q) FILTER (fits), '') AS text,
        round(CASE WHEN max(q) % 3 = 0 THEN 0.5 ELSE avg(q / 64.0::double) FILTER (fits AND q % 4 <> 0) END, 6) AS confidence FROM g GROUP BY id""",
    "box_matches": """WITH l AS (SELECT DISTINCT l_orderkey AS id, l_linenumber AS n, l_quantity AS q, l_returnflag AS f FROM lineitem),
      t AS (SELECT DISTINCT id, q FROM l), b AS (SELECT t.id, t.q, coalesce(max(CASE WHEN greatest(0, least(t.q, n + l.q) - n) = 0 THEN 0 ELSE greatest(0, least(t.q, n + l.q) - n) / (t.q + l.q - greatest(0, least(t.q, n + l.q) - n)) END), 0) AS best
        FROM t LEFT JOIN l ON l.id = t.id AND f <> 'R' GROUP BY 1, 2)
      SELECT id, round(avg(best), 12) AS score FROM b GROUP BY 1""",
    "visual_payloads": """SELECT vec_id, 'space' || (label % 3) AS space, len(embedding)::int AS dimension, round(embedding[1]::double, 3) + 0.0::double AS first FROM embeddings WHERE vec_id % 7 NOT IN (1, 2, 3)""",
    "contract_faults": """SELECT o_orderkey AS id, ['no object', 'no object', 'missing: tags', 'missing: name, tags', 'type: name', 'type: tags', 'type: count', NULL, NULL][o_orderkey % 9 + 1] AS fault FROM orders""",
    "scene_keyframes": """WITH r AS (SELECT event_id, user_id AS video_id, floor(value)::bigint AS at_ms, event_type, value - floor(value) < 0.75::double AS fine FROM events),
      k AS (SELECT video_id, at_ms, max(event_id) AS keyframe_id, arg_max(fine, event_id) AS fine FROM r WHERE event_type = 'view' GROUP BY 1, 2)
      SELECT r.video_id, r.event_id AS scene, keyframe_id, CASE WHEN k.fine THEN 1.0 ELSE 0.0 END::double AS fraction FROM r LEFT JOIN k ON k.video_id = r.video_id AND k.at_ms = r.at_ms WHERE r.event_type = 'click'""",
    "video_coverage": _COVERAGE,
    "accepted_media": f"WITH {LATEST_FILES}, m AS (SELECT id, mime FROM latest_files) SELECT * FROM m WHERE mime LIKE 'image/%' OR mime = 'application/pdf' OR mime LIKE 'text/m_rkdown'",
    "document_understanding": """WITH r AS (SELECT l_orderkey AS id, list_distinct(list(l_linenumber)) AS rich FROM lineitem WHERE l_quantity >= 20 GROUP BY 1),
      d AS (SELECT o_orderkey AS id, o_orderstatus <> 'P' AS native, (o_custkey % 8)::int AS n, o_orderkey % 11 = 0 AS e, coalesce(rich, []) AS rich FROM orders LEFT JOIN r ON r.id = o_orderkey),
      i AS (SELECT *, list_filter(range(1, n + 1), lambda x: NOT list_contains(rich, x)) AS image FROM d)
      SELECT id, native, CASE WHEN NOT e THEN array_to_string(image, ',') END AS image_pages, CASE WHEN e THEN 'unavailable' WHEN len(image) = 0 THEN 'native' WHEN len(image) > 0.5 * n THEN 'ocr' ELSE 'hybrid' END AS outcome FROM i""",
}
