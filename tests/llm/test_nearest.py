import numpy as np
import pytest

from lodemill.llm.nearest import nearest_vectors
from lodemill.llm.vptree import Hits, Tree, search


def brute(rows, k=5, dimension=8):
    ids, x = [], []
    for i, v in dict.fromkeys((i, tuple(v) if v is not None else None) for i, v, *_ in rows):
        a = np.array(v, dtype=np.float32).astype(float) if v is not None and None not in v else np.array([])
        if i is not None and len(a) == dimension and np.isfinite(a).all() and a.any():
            ids.append(i)
            x.append(a)
    out = {}
    for i, a in zip(ids, x):
        near = sorted((float(((a - b) ** 2).sum()), j) for j, b in zip(ids, x) if j != i)[:k]
        out[i] = [j for _, j in near]
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "id string, vector array<float>, no int, h string")
    out = {}
    for r in sorted(nearest_vectors(df, dimension=8, factor=1.0, **options).collect(), key=lambda r: (r.id, r.rank)):
        out.setdefault(r.id, []).append(r.neighbour)
    return out


@pytest.mark.parametrize("options", [{}, {"shard": 20, "bucket": 4, "sample": 100}, {"shard": 30, "bucket": 6, "most": 7}])
def test_exact_with_factor_one(spark, options):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(9, 8))
    rows = [(f"v{i:03d}", [float(c) for c in centres[i % 9] + 0.1 * rng.normal(size=8)], 0, "") for i in range(150)]
    rows += [(f"copy{i}", rows[3][1], 0, "") for i in range(9)] + rows[:10]
    rows += [(f"unit{i}", [float(i % 8 == k) for k in range(8)], 0, "") for i in range(12)]  # equal distances
    rows += [("null", None, 0, ""), ("short", [1.0], 0, ""), ("zero", [0.0] * 8, 0, ""), ("nan", [float("nan")] * 8, 0, ""), ("inf", [float("inf")] * 8, 0, ""), (None, rows[0][1], 0, ""), ("hole", [1.0, None] * 4, 0, "")]
    assert run(spark, rows, **options) == brute(rows)


def test_few_and_none(spark):
    assert run(spark, []) == {}
    assert run(spark, [("a", [1.0] * 8, 0, "")]) == {}
    assert run(spark, [("a", [1.0] * 8, 0, ""), ("b", [2.0] * 8, 0, "")]) == {"a": ["b"], "b": ["a"]}


def test_recall_when_relaxed():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(300, 64))
    x = centres[rng.integers(0, 300, 6000)] + 0.15 * rng.normal(size=(6000, 64))
    numbers = np.arange(len(x))
    queries = numbers[::20]
    square = (x[queries] ** 2).sum(1)[:, None] + (x**2).sum(1) - 2 * x[queries] @ x.T
    square[np.arange(len(queries)), queries] = np.inf
    truth = np.argsort(square, axis=1)[:, :5]
    hits = Hits(len(queries), 5)
    search(Tree(x, 128, 0.3), x, numbers, x[queries], queries, hits, 0.5)
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(truth, hits.number)]) >= 0.9
