import math
import random

import pytest
from pyspark.sql import functions as F

from lodemill.operators import graph, retrieval, vectors

FILES = "file_id string, path string, summary string"


def tables(spark, mentions=(), about=(), refs=(), dups=()):
    return {
        "mentions": spark.createDataFrame(list(mentions), "file_id string, entity string, weight double"),
        "about": spark.createDataFrame(list(about), "file_id string, topic string, weight double"),
        "references": spark.createDataFrame(list(refs), "src string, dst string"),
        "duplicates": spark.createDataFrame(list(dups), "src string, dst string, similarity double"),
    }


def chunks(spark, rows):
    return spark.createDataFrame([(f"{f}:{n}", f, v) for n, (f, v) in enumerate(rows)], "id string, file_id string, vector array<float>")


@pytest.fixture
def files(spark):
    return spark.createDataFrame([("f1", "/docs/a.md", "a"), ("f2", "/docs/b.md", "b"), ("f3", "/docs/c.md", None)], FILES)


def test_two_hits_by_distance(spark, files):
    rows = chunks(spark, [("f1", [0.9, 0.1] + [0.0] * 6), ("f2", [0.1] + [0.0] * 7), ("f3", None), ("f3", [float("nan")] * 8), ("f3", [1.0])])
    out = retrieval.search([0.5] * 8, rows, files, tables(spark)).collect()
    assert [r.file_id for r in out] == ["f1", "f2"]
    assert [round(r.score, 4) for r in out] == [0.1773, 0.1718]


def test_peers_and_fusion(spark, files):
    edges = tables(spark, mentions=[("f1", "Acme", 1.0), ("f2", "Acme", 1.0)])
    out = {r.file_id: r for r in retrieval.receipts(retrieval.search([0.5] * 8, chunks(spark, [("f1", [0.5] * 8)]), files, edges)).collect()}
    assert out["f1"].score == 0.5 and out["f2"].score == pytest.approx(0.12)
    assert out["f2"].why == "shares 1 entities: Acme" and out["f1"].why == "vector similarity 1.00"


def test_no_query_no_rows(spark, files):
    assert retrieval.search(None, chunks(spark, [("f1", [0.5] * 8)]), files, tables(spark)).count() == 0
    assert retrieval.search([0.5] * 8, chunks(spark, []), files, tables(spark)).count() == 0


def scored(spark, rows):
    kinds = "file_id string, path string, similarity double, entity_weight double, entities int, topic_weight double, topics int, citations int, duplicate_similarity double"
    return retrieval.contributions(spark.createDataFrame(rows, kinds), retrieval.Weights())


def test_caps_and_clamps(spark):
    rows = [
        ("all", "/a", 1.0, 20.0, 20, 20.0, 20, 1, None),
        ("entities", "/b", None, 20.0, 20, None, 0, 0, None),
        ("topics", "/c", None, None, 0, 20.0, 20, 0, None),
        ("duplicate", "/d", None, None, 0, None, 0, 0, 0.99),
        ("two", "/e", 0.6, 1.0, 1, None, 0, 0, None),
    ]
    got = {r.file_id: (round(r.score, 6), r.evidence_count) for r in scored(spark, rows).collect()}
    assert got == {"all": (1.0, 4), "entities": (0.3, 1), "topics": (0.2, 1), "duplicate": (0.0, 1), "two": (0.42, 2)}


def test_order_is_total(spark):
    rows = [(f"f{i}", f"/p{i}", 0.5, None, 0, None, 0, 0, None) for i in range(10)]
    rows += [("x", "/z", 0.26, 1.0, 1, None, 0, 0, None)]  # the score of the others with two signals
    for seed in range(5):
        random.Random(seed).shuffle(rows)
        out = [r.file_id for r in scored(spark, rows).repartition(seed + 1).orderBy(*retrieval.rank_key()).collect()]
        assert out == ["x", *[f"f{i}" for i in range(10)]]
    assert math.isclose(0.12 + 0.5 * 0.26, 0.25)


def test_weight_gate(spark):
    edges = tables(spark, mentions=[("f1", "Acme", 0.8), ("f2", "Acme", 0.6), ("f3", "Acme", 0.2)], refs=[("f1", "f3"), ("f1", "f1")], dups=[("f1", "f2", 0.1)])
    frontier = spark.createDataFrame([("f1",)], "file_id string")

    def hops(gate):
        return {(r.peer, r.via, r.weight) for r in graph.neighbours(frontier, edges["references"], graph.connectors(edges["mentions"], edges["about"]), edges["duplicates"], gate).collect()}

    assert hops(None) == {("f2", "mentioned-entity", 0.6), ("f3", "mentioned-entity", 0.2), ("f3", "references", 1.0), ("f2", "duplicate", 0.1)}
    assert hops(0.35) == {("f2", "mentioned-entity", 0.6), ("f3", "references", 1.0), ("f2", "duplicate", 0.1)}
    first = graph.related(graph.neighbours(frontier, edges["references"], graph.connectors(edges["mentions"], edges["about"]), edges["duplicates"]))
    assert {(r.peer, r.via) for r in first.collect()} == {("f2", "mentioned-entity"), ("f3", "references")}


def test_references(spark):
    files = spark.createDataFrame([("a", "/x/y.md"), ("b", "/x/z/y.md"), ("c", "/q/only.md"), ("d", None)], "file_id string, path string")
    asked = [("s", "y.md"), ("s", "x/y.md"), ("s", "z/y.md"), ("s", "elsewhere/only.md"), ("s", "nonexistent.md"), ("s", " "), ("s", None), ("c", "only.md")]
    out = graph.resolve_references(spark.createDataFrame(asked, "source_id string, reference string"), files)
    got = {(r.source_id, r.reference): r.file_id for r in out.collect()}
    assert got == {("s", "x/y.md"): "a", ("s", "z/y.md"): "b", ("s", "elsewhere/only.md"): "c", ("c", "only.md"): "c"}
    assert {tuple(r) for r in graph.reference_edges(out).collect()} == {("s", "a"), ("s", "b"), ("s", "c")}


def test_context_budget(spark, files):
    rows = [("f1", [0.9, 0.1] + [0.0] * 6), ("f2", [0.1] + [0.0] * 7)]
    c = chunks(spark, rows)
    ranked = retrieval.search([0.5] * 8, c, files, tables(spark))
    hits = vectors.top_chunks(c, [0.5] * 8, 16)
    texts = c.select("id", F.lit("x" * 300).alias("text"))
    used = lambda most: [(r.position, r.cost, r.used) for r in retrieval.context(ranked, hits, texts, most).orderBy("position").collect()]
    assert used(400) == [] and used(475) == [(1, 75, 475)] and used(600) == [(1, 75, 475), (2, 75, 550)]


def test_calibration(spark):
    signals = spark.createDataFrame([("r1", "a", 0.2), ("r2", "a", 0.6), ("r3", "a", 1.0), ("r1", "b", 0.7)], "resource_id string, route string, raw_score double")
    got = {(r.resource_id, r.route): r.calibrated for r in retrieval.calibrated(signals).collect()}
    assert got == {("r1", "a"): 0.0, ("r2", "a"): pytest.approx(0.5), ("r3", "a"): 1.0, ("r1", "b"): 1.0}
    assert {r.resource_id: (r.score, r.signals) for r in retrieval.fused(signals).collect()}["r1"] == (1.0, 2)


def test_mean_vectors(spark):
    rows = chunks(spark, [("f", [1.0, 3.0]), ("f", [3.0, 5.0]), ("f", [1.0]), (None, [1.0, 1.0])])
    assert [(r.file_id, r["mean"]) for r in vectors.mean_vectors(rows.union(rows), 2).collect()] == [("f", [2.0, 4.0])]
