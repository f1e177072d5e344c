import difflib
import io
import random
import struct

import pytest
from pyspark.sql import functions as F

from lodemill.functions import paths
from lodemill.functions import text as t
from lodemill.functions.patches import apply_diff, patched
from lodemill.operators import blobs, changesets, derived, evaluation, images, projection, representations
from lodemill.operators.extensions import Extensions, Pipeline


def test_diffs_made_by_a_library_apply():
    rng = random.Random(3)
    for n in range(200):
        old = [f"line {rng.randrange(6)}" + "\n" for _ in range(rng.randrange(0, 25))]
        new = list(old)
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(len(new) + 1)
            new[at : at + rng.randrange(0, 3)] = [f"new {rng.randrange(9)}\n" for _ in range(rng.randrange(0, 3))]
        diff = "".join(difflib.unified_diff(old, new, "a", "b", n=rng.randrange(0, 4)))
        assert apply_diff("".join(old), diff) == "".join(new), n


def test_diffs_that_do_not_fit():
    diff = "--- a\n+++ b\n@@ -1,2 +1,2 @@\n one\n-two\n+2\n"
    assert apply_diff("one\ntwo\n", diff) == "one\n2\n"
    assert apply_diff("one\nthree\n", diff) is None and apply_diff("", diff) is None
    assert apply_diff("one\ntwo\n", diff[:-3]) is None and apply_diff("x", "nonsense") is None
    bare = "@@ -1 +1 @@\n-a\n\\ No newline at end of file\n+b\n\\ No newline at end of file\n"
    assert apply_diff("a", bare) == "b"


def test_patches_are_checked_by_hash(spark):
    import hashlib

    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    diff = "@@ -1 +1 @@\n-a\n+b\n"
    rows = [(1, "a\n", diff, h("a\n"), h("b\n")), (2, "a\n", diff, h("x"), None), (3, "a\n", diff, None, h("x")), (4, None, diff, None, None), (5, "a\n", diff, None, None)]
    df = spark.createDataFrame(rows, "n int, text string, diff string, old string, new string")
    got = {r.n: r.out for r in df.select("n", patched(F.col("text"), F.col("diff"), F.col("old"), F.col("new")).alias("out")).collect()}
    assert got == {1: "b\n", 2: None, 3: None, 4: None, 5: "b\n"}


def jpeg(order: str, orientation: int, gps: bool, cut: int | None = None) -> bytes:
    entries = [struct.pack(order + "HHIHH", 0x112, 3, 1, orientation, 0)] + ([struct.pack(order + "HHII", 0x8825, 4, 1, 38)] if gps else [])
    block = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(entries)) + b"".join(entries) + b"\0\0\0\0"
    if gps:
        block += struct.pack(order + "H", 4) + struct.pack(order + "HHI4s", 1, 2, 2, b"S\0") + struct.pack(order + "HHII", 2, 5, 3, 92) + struct.pack(order + "HHI4s", 3, 2, 2, b"E\0") + struct.pack(order + "HHII", 4, 5, 3, 116) + b"\0" * 4
        block += struct.pack(order + "6I", 10, 1, 30, 1, 36, 1) + struct.pack(order + "6I", 20, 1, 15, 1, 0, 1)
    payload = b"Exif\0\0" + block[:cut]
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(payload) + 2) + payload + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 40, 30, 3) + b"\0" * 9 + b"\xff\xd9"


@pytest.mark.parametrize("order", ["<", ">"])
def test_place_and_orientation(order):
    assert images.exif(jpeg(order, 6, False)) == (6, False, None, None)
    turned, placed, latitude, longitude = images.exif(jpeg(order, 3, True))
    assert (turned, placed) == (3, True) and latitude == pytest.approx(-10.51) and longitude == 20.25
    assert images.exif(jpeg(order, 9, False))[0] == 1
    for cut in range(0, 140, 7):  # damaged blocks tell less, but never fail
        images.exif(jpeg(order, 6, True, cut))
    assert images.details("image/jpeg", jpeg(order, 6, True))[:7] == (30, 40, 8, "ycbcr", False, 6, "location")


def test_places_come_out_only_if_asked_for(spark):
    df = spark.createDataFrame([("a", bytearray(jpeg("<", 6, True)), 1), ("b", None, 1), ("c", bytearray(b"x"), 1)], "path string, content binary, width int")
    row = images.image_details(df).collect()
    assert [(r.path, r.privacy, r.latitude) for r in row] == [("a", "location", None)]
    assert images.image_details(df, True).first().latitude == pytest.approx(-10.51)


def test_segments(spark):
    rows = [(1, "speech", "hello", "SPEAKER_1", None, 0.9), (2, "silence", "", "SPEAKER_1", None, 0.5), (3, "unsupported_language", None, None, "xx", 0.4), (4, "other", None, None, None, None)]
    got = {r.segment_id: r for r in derived.segment_rows(spark.createDataFrame(rows, "segment_id int, kind string, text string, speaker string, language string, confidence double")).collect()}
    assert got[1].payload == "[SPEAKER_1] hello" and got[1].confidence == 0.9 and got[1].detail == "speech"
    assert got[2].status == "current" and got[2].payload == "" and got[2].confidence is None
    assert got[3].detail == "speech in an unsupported language (xx)" and got[3].fraction == 0.0
    assert got[4].status == "partial" and got[4].detail is None


def test_json_of_recognisers(spark):
    rows = [(1, '{"regions":[{"text":"a","bbox":[0,0,1,1],"confidence":0.5},{"text":"b","bbox":[0,0,1]},7,{"bbox":[0,0,1,1]},{"text":"c","bbox":[0,0,1,2]}]}'), (2, "{broken"), (3, None), (4, '{"confidence":0.25,"regions":[]}')]
    df = spark.createDataFrame(rows, "n int, j string")
    got = {r.n: (None if r.x is None else [y.text for y in r.x], r.c) for r in df.select("n", derived.regions(F.col("j")).alias("x"), derived.recognition_confidence(F.col("j")).alias("c")).collect()}
    assert got == {1: (["a", "c"], 0.5), 2: (None, None), 3: (None, None), 4: ([], 0.25)}


def test_coverage_plans(spark):
    rows = [(1, 60_000, 640, 480, False, False), (2, 0, 1, 1, False, False), (3, 1000, None, 2, False, False), (4, 60_000, 640, 480, True, False), (5, 60_000, 4000, 3000, False, False), (6, 2_000_000, 640, 480, False, False), (7, 9_000_000, 640, 480, None, None), (8, None, None, None, None, None)]
    plans = derived.coverage_plans(spark.createDataFrame(rows, "video_id int, duration_ms bigint, width bigint, height bigint, encrypted boolean, malformed boolean"))
    got = {r.video_id: (r.policy, r.keyframes, r.gap_ms, r.fraction, r.reasons) for r in plans.collect()}
    assert got[1] == ("sampled", 30, 2000, 1.0, [])
    assert [got[n][0] for n in range(2, 9)] == ["unavailable", "unavailable", "unavailable", "ask", "ask", "unavailable", "unavailable"]
    assert got[5][4] == ["compute class"] and got[7][4] == ["hard duration"]


def test_path_faults(spark):
    cases = {"a/b.md": None, "/vault/a": None, "/vaults/a": "cross_workspace", "": "non_canonical", "  ": "non_canonical", "a/../b": "traversal", "a/nul": "special", "x" * 256: "non_canonical", "y/" * 3000: "non_canonical", "./a": None, None: "non_canonical"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.f for r in df.select("p", paths.path_fault(F.col("p"), "/vault").alias("f")).collect()} == cases


def test_changes_of_representations(spark):
    rows = spark.createDataFrame([("p", "pending"), ("c", "current"), ("n", None)], "id string, status string")
    asked = spark.createDataFrame([("p", "current"), ("c", "partial"), ("c", "partial"), ("x", "failed"), ("n", "failed")], "id string, new_status string")
    assert {tuple(r) for r in representations.transitioned(rows, asked).collect()} == {("p", "current", "changed"), ("c", "current", "refused"), ("x", None, "missing"), ("n", None, "missing")}


def test_blobs(spark):
    kinds = "content binary, retained_until timestamp"
    empty = spark.createDataFrame([], "hash string, content binary, byte_count bigint, references bigint, retained_until timestamp")
    store = blobs.put(empty, spark.createDataFrame([(bytearray(b"a"), None), (bytearray(b"a"), None), (bytearray(b"bb"), None), (None, None)], kinds))
    assert sorted((r.byte_count, r.references) for r in store.collect()) == [(1, 2), (2, 1)]
    left = blobs.release(store, store.where("byte_count = 2").select("hash").union(store.where("byte_count = 2").select("hash")))
    assert sorted((r.byte_count, r.references) for r in left.collect()) == [(1, 2), (2, 0)]
    assert blobs.damaged(store).count() == 0 and blobs.damaged(store.withColumn("hash", F.lit("x"))).count() == 2


def test_extraction_is_applied_once_and_again(spark):
    edges = spark.createDataFrame([("f", "entity", "old", 1.0), ("g", "topic", "kept", 0.5)], "file_id string, kind string, name string, weight double")
    kinds = "file_id string, entities array<struct<name:string,weight:double>>, topics array<struct<name:string,weight:double>>, references array<string>"
    new = spark.createDataFrame([("f", [("new ", 0.2), ("new", 0.9), (" ", 1.0), (None, 1.0)], None, ["x.md", "x.md ", ""])], kinds)
    once = projection.extraction_applied(edges, new)
    want = {("g", "topic", "kept", 0.5), ("f", "entity", "new", 0.9), ("f", "intent", "x.md", 1.0)}
    assert {tuple(r) for r in once.collect()} == want and {tuple(r) for r in projection.extraction_applied(once, new).collect()} == want


def test_recall_by_counts(spark):
    returned = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query string, id string, place int")
    expected = spark.createDataFrame([("q", "c"), ("q", "b"), ("q", "b"), ("q", "z"), ("none", "a")], "query string, id string")
    got = {r["query"]: (r.expected, r.recall, r.reciprocal_rank) for r in evaluation.recall_by_counts(returned, expected, 2).collect()}
    assert got == {"q": (3, pytest.approx(1 / 3), 0.5), "none": (1, 0.0, 0.0)}


def test_evidence_is_found_in_any_text(spark):
    event = "11111111-2222-3333-4444-555555555555"
    log = spark.createDataFrame([(event, 7), (event[:-1] + "6", 9)], "id string, sequence bigint")
    moves = spark.createDataFrame([("c", 1, f"see {event}, done"), ("c", 2, "nothing"), ("d", 1, None)], "change_set_id string, occurred_at int, evidence string")
    assert [tuple(r) for r in changesets.last_validated(moves, log).collect()] == [("c", 7)]


def test_lists_in_json_and_expiry(spark):
    df = spark.createDataFrame([('["a","b"]', "a"), ('["a"]', "c"), ("broken", "a"), (None, "a")], "j string, v string")
    assert [r.x for r in df.select(t.json_has(F.col("j"), F.col("v")).alias("x")).collect()] == [True, False, False, False]


def test_zip_of_a_document_is_told(spark):
    import zipfile

    from lodemill.operators import media

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "x")
        z.writestr("xl/book.xml", "x")
    df = spark.createDataFrame([("a.xlsx", bytearray(out.getvalue())), ("b.png", bytearray(out.getvalue())), ("c", None), ("d", bytearray(b""))], "path string, content binary")
    got = {r.path: (r.media_type, r.mismatch) for r in media.describe(df).collect()}
    assert got["a.xlsx"] == (media.OFFICE["xl/"], False) and got["b.png"][1] and got["c"] == got["d"] == (None, False)


def test_extensions(spark):
    seen = []

    def run(rows):
        seen.append(len(seen))
        return rows.select("id", F.when(F.col("content") != "bad", F.concat(F.col("content"), F.lit("!"))).alias("payload"))

    ext = Extensions([lambda c: F.when(c == "x", "text/x"), lambda c: F.lit("text/any")], [Pipeline("one", "text/*", "k", run, retry=True), Pipeline("two", "*", "k", lambda rows: rows.select("id", F.lit("two").alias("payload"))), Pipeline("other", "*", "j", run)], {"v": (2, lambda t: F.array(F.length(t), F.lit(1)))})
    rows = spark.createDataFrame([(1, "text/a", "a", "z"), (2, "text/b", "bad", "z"), (3, "image/x", None, "z"), (4, None, "d", "z"), (5, "text/c", "c", "z")], "id int, mime string, content string, payload string")
    cached = spark.createDataFrame([(5, "one@1", "kept"), (1, "one@0", "old"), (9, "one@1", "x")], "id int, pipeline string, payload string")
    got = {r.id: (r.pipeline, r.status, r.payload) for r in ext.produced(rows, "k", cached).collect()}
    assert got == {1: ("one@1", "current", "a!"), 2: ("one@1", "failed", None), 3: ("two@1", "current", "two"), 4: (None, "unavailable", None), 5: ("one@1", "current", "kept")}
    assert ext.produced(rows.limit(0), "k").count() == 0 and ext.produced(rows, "none").count() == 5
    assert [r.vector for r in ext.encoded(rows.orderBy("id"), "v", "content").collect()][:3] == [[1.0, 1.0], [3.0, 1.0], None]
    assert [r.t for r in rows.select(ext.detected(F.lit("x")).alias("t")).limit(1).collect()] == ["text/x"]
