import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodemill.operators import budget, events, intervals, records, representations
from lodemill.operators.evaluation import best_adapter, box_overlap, recall_and_rank
from lodemill.plans import state


def test_gaps(spark):
    rows = [("a", n) for n in (1, 2, 4, 4, 7, 20000, 20001, 40000)] + [("b", 5), ("b", None), (None, 1), (None, 3)]
    df = spark.createDataFrame(rows, "workspace_id string, sequence long")
    want = {("a", 2, 4), ("a", 4, 7), ("a", 7, 20000), ("a", 20001, 40000), (None, 1, 3)}
    for bits in (0, 3, 14):
        assert {tuple(r) for r in events.gaps(df, block_bits=bits).collect()} - {(None, 1, 3)} == want - {(None, 1, 3)}
    assert events.gaps(df.limit(0)).count() == 0


def test_first_fit(spark):
    def fit(rows, most):
        df = spark.createDataFrame([("w", *r) for r in rows], "g string, key string, section string, priority int, ord int, cost long")
        return {r.key: r.included for r in budget.first_fit(df, "g", most).collect()}

    assert fit([("a", "s", 0, 0, 60), ("b", "s", 0, 1, 50), ("c", "s", 0, 2, 40)], 100) == {"a": True, "b": False, "c": True}
    assert fit([("huge", "s", 0, 0, 500), ("tiny", "s", 10, 1, 5)], 5) == {"huge": False, "tiny": True}
    assert fit([("x", "s", 0, 0, 1)], 0) == {"x": False}
    with pytest.raises(ValueError):
        fit([("x", "s", 0, 0, 1)], -1)


def test_packing(spark):
    rng = random.Random(1)
    rows = [(f"g{i % 3}", i, rng.randrange(0, 90)) for i in range(200)] + [("one", 1, 500), ("one", 2, 1), (None, 1, None)]
    df = spark.createDataFrame(rows, "g string, o int, c int")
    packs = {}
    for bits, g in [(bits, g) for bits in (12, 3, 0) for g in sorted({r[0] for r in rows}, key=str)]:
        got = packs.setdefault(bits, {})
        if not got:
            for r in budget.pack_consecutive(df, "g", "o", "c", 100, bits).collect():
                got.setdefault(r.g, {})[r.o] = r.pack
        used, pack = None, 0
        for _, o, c in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            c = c or 0
            if used is not None and used + c > 100:
                pack, used = pack + 1, c
            else:
                used = (used or 0) + c
            assert got[g][o] == pack


def test_speakers(spark):
    segments = spark.createDataFrame([("r", 0, 1500), ("r", 1500, 2000), ("r", 5000, 6000), ("q", 0, 10)], "k string, start_ms long, end_ms long")
    speakers = spark.createDataFrame([("r", 0, 1000, "S1", 0), ("r", 1000, 2000, "S2", 1)], "k string, start_ms long, end_ms long, label string, ordinal int")
    for bucket in (300, 10_000):
        got = {(r.k, r.start_ms): r.label for r in intervals.label_by_overlap(segments, speakers, "k", bucket).collect()}
        assert got == {("r", 0): "S1", ("r", 1500): "S2", ("r", 5000): None, ("q", 0): None}


def test_speaker_ties_follow_the_order_of_examination(spark):
    def walk(seg, sp):
        best, most = None, 0
        for s, e, label in sp:
            o = min(seg[1], e) - max(seg[0], s)
            if o > most or (o == most and o > 0 and best is not None and s < seg[0]):
                most, best = o, label
        return best

    rng = random.Random(3)
    segs, sps = [], []
    for k in range(40):
        a = rng.randrange(0, 20)
        segs.append((f"k{k}", a, a + rng.randrange(1, 10)))
        for n in range(6):
            s = rng.randrange(0, 20)
            sps.append((f"k{k}", s, s + rng.randrange(1, 10), f"L{n}", n))
    a = spark.createDataFrame(segs, "k string, start_ms long, end_ms long")
    b = spark.createDataFrame(sps, "k string, start_ms long, end_ms long, label string, ordinal int")
    got = {r.k: r.label for r in intervals.label_by_overlap(a, b, "k", 4).collect()}
    assert got == {k: walk((s, e), [(x, y, l) for kk, x, y, l, _ in sps if kk == k]) for k, s, e in segs}


def test_boundaries_and_scenes(spark):
    marks = spark.createDataFrame([("v", 10_000), ("v", 10_000), ("w", 1000), ("v", 50_000)], "k string, boundary long")
    spans = spark.createDataFrame([("v", 40_000), ("w", 0), ("x", 31_000)], "k string, duration long")
    rows = {}
    filled = intervals.filled_boundaries(marks, spans, "k", 15_000)
    for r in filled.collect():
        rows.setdefault(r.k, []).append(r.boundary)
    assert {k: sorted(v) for k, v in rows.items()} == {"v": [0, 10_000, 25_000, 40_000], "w": [0], "x": [0, 15_000, 30_000, 31_000]}
    s = intervals.scenes(filled, "k")
    assert {(r.start_ms, r.end_ms, r.keyframe_ms) for r in s.where("k = 'v'").collect()} == {(0, 10_000, 5000), (10_000, 25_000, 17_500), (25_000, 40_000, 32_500)}
    assert {r.start_ms for r in intervals.spread(s.where("k = 'v'"), "k", "start_ms", 2).collect()} == {0, 25_000}


def test_scene_texts(spark):
    scenes = spark.createDataFrame([("v", 0, 100), ("v", 100, 200), ("v", 200, 300)], "k string, start_ms long, end_ms long")
    segs = spark.createDataFrame([("v", 90, 110, 2, "b"), ("v", 0, 5, 1, "a"), ("v", 199, 200, 3, "c"), ("v", 50, 50, 4, "empty")], "k string, start_ms long, end_ms long, ord int, text string")
    got = {r.start_ms: r.text for r in intervals.texts_in(scenes, segs, "k", 64).collect()}
    assert got == {0: "a\nb", 100: "b\nc", 200: ""}


def test_freshness_and_delivery(spark):
    outbox = spark.createDataFrame([("graph", "w", 1), ("vector", "w", 2), ("graph", "w", 3)], "projection string, workspace_id string, id long")
    offsets = spark.createDataFrame([("graph", "w", 3), ("old", "w", 9)], "projection string, workspace_id string, applied long")
    got = {r.projection: (r.applied, r.latest, r.lag, r.lagging) for r in events.freshness(outbox, offsets).collect()}
    assert got == {"graph": (3, 3, 0, False), "vector": (0, 2, 1, True), "old": (9, 0, 0, False)}
    batch = events.delivery_batch(outbox, offsets.limit(0), 1).collect()
    assert {(r.projection, r.id) for r in batch} == {("graph", 1), ("vector", 2)}


def test_leases(spark):
    t = dt.datetime(2025, 1, 1)
    leases = spark.createDataFrame([("l1", ["a", "b"], "active", t + dt.timedelta(1)), ("l2", ["a"], "active", t), ("l3", ["a"], "released", t + dt.timedelta(1)), ("l4", None, "active", t + dt.timedelta(1))], "lease_id string, scope array<string>, status string, expires_at timestamp")
    wanted = spark.createDataFrame([("r", ["b", "a", "a", "z"]), ("l1", ["a"])], "request_id string, paths array<string>")
    assert [(r.request_id, r.lease_id, r.paths) for r in events.lease_conflicts(leases, wanted, F.lit(t)).collect()] == [("r", "l1", ["a", "b"])]


def test_every_later_order_asks_for_leases(spark, tmp_path):
    days = {1: dt.datetime(1998, 7, 10), 2: dt.datetime(1998, 7, 20), 3: dt.datetime(1998, 8, 1), 4: dt.datetime(2001, 8, 1), 5: dt.datetime(1998, 7, 6)}
    spark.createDataFrame(list(days.items()), "o_orderkey long, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, 10), (1, 11), (2, 11), (3, 10), (4, 10), (4, 11), (4, 11), (5, 10)], "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = {tuple(r) for r in state.lease_conflicts_all(spark, str(tmp_path)).collect()}
    assert found == {(2, 1, "11"), (3, 1, "10"), (4, 1, "10,11"), (4, 2, "11")}
    assert {tuple(r) for r in state.lease_conflicts(spark, str(tmp_path)).collect()} == {x for x in found if x[0] == 3}


def test_records(spark):
    t = dt.datetime(2025, 1, 1)
    kinds = "id string, path string, status string, content_hash string, mtime double, size_bytes long, last_indexed_at timestamp"
    rows = [("a", "/a", "pending", "h0", 1.0, 1, None), ("a", "/a", "indexed", "h1", 2.0, 1, t), ("b", "/b", None, "h2", 0.0, 0, None), (None, "/c", "indexed", "h3", 0.0, 0, t)]
    files = spark.createDataFrame(rows, kinds)
    latest = records.latest_files(files.union(files))
    assert {(r.id, r.status) for r in latest.collect()} == {("a", "indexed"), ("b", None)}
    assert {r.status: r.files for r in records.count_by_status(latest).collect()} == {"indexed": 1, "pending": 1}
    assert [r.id for r in records.work_list(latest, files).collect()] == ["b"]
    disk = spark.createDataFrame([("/a", "x"), ("/n", "y"), ("/s", None)], "path string, content_hash string")
    known = spark.createDataFrame([("/a", "h"), ("/g", "z"), ("/s", None)], "path string, content_hash string")
    assert {tuple(r) for r in records.reconcile(disk, known).collect()} == {("/a", "updated"), ("/n", "created"), ("/g", "deleted")}
    table = spark.createDataFrame([("f", 0), ("f", 1), ("g", 0)], "file_id string, n int")
    assert {tuple(r) for r in records.replace_by_key(table, spark.createDataFrame([("f", 9)], table.schema), "file_id").collect()} == {("f", 9), ("g", 0)}


def test_metrics(spark):
    t = dt.datetime(2025, 1, 1)
    df = spark.createDataFrame([("m", 2.0, t, 1), ("m", 5.0, t + dt.timedelta(1), 2), ("m", None, t, 3)], "name string, value double, at timestamp, n int")
    assert tuple(events.metric_summary(df, "name", "value", "at", "n").first()) == ("m", 2, 7.0, 2.0, 5.0, 5.0, 3.5)
    j = spark.createDataFrame([("ocr", ["a", "b", "c"], ["a"]), ("ocr", ["x", "b"], ["b"]), ("tr", ["x", "y", "z"], ["z"]), ("tr", ["x"], [])], "modality string, returned array<string>, expected array<string>")
    got = {r.modality: (r.queries, r.recall, round(r.reciprocal_rank, 4)) for r in recall_and_rank(j, 2).collect()}
    assert got == {"ocr": (2, 1.0, 0.75), "tr": (1, 0.0, 0.3333)}
    box = spark.sql("select named_struct('left', 0d, 'top', 0d, 'right', 100d, 'bottom', 100d) a, named_struct('left', 50d, 'top', 50d, 'right', 150d, 'bottom', 150d) b")
    assert box.select(box_overlap(F.col("a"), F.col("b"))).first()[0] == pytest.approx(2500 / 17500)
    scores = spark.createDataFrame([("acc", "a", "c1", 1.0), ("acc", "a", "c1", 0.0), ("acc", "b", "c1", 0.5), ("acc", "b", "c2", 0.6)], "metric string, adapter string, case string, value double")
    assert best_adapter(scores).first().adapter == "b"


def test_representations(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [("1", "v", "ocr_text", "current", t, "fp"), ("2", "v", "ocr_text", "failed", t + dt.timedelta(1), "fp"), ("3", "w", "ocr_text", "partial", t, "fp"), ("4", "u", "ocr_text", "failed", t, None)]
    df = spark.createDataFrame(rows, "id string, resource_version_id string, kind string, status string, created_at timestamp, pipeline_fingerprint string")
    assert {r.resource_version_id: r.id for r in representations.current_per_kind(df).collect()} == {"v": "2", "w": "3", "u": "4"}
    found = representations.cache_probe(spark.createDataFrame([("v", "ocr_text", "fp"), ("z", "ocr_text", "fp"), ("z", "x", "fp"), ("z", "ocr_text", None)], "resource_version_id string, kind string, pipeline_fingerprint string"), df)
    assert {(r.resource_version_id, r.id, r.exact) for r in found.collect()} == {("v", "1", True), ("z", "3", False)}
    assert {r.resource_version_id: (r.fraction, r.complete) for r in representations.coverage(df).collect()} == {"v": (0.5, False), "w": (0.0, False), "u": (0.0, False)}
