import random

import pytest

from lodemill.llm.components import link_groups


def brute(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {x: root(x) for x in up}


def run(spark, edges):
    rows = link_groups(spark.createDataFrame(edges, "src string, dst string, group_id int, u int")).collect()
    assert len(rows) == len({r.member for r in rows})
    return {r.member: r.group_id for r in rows}


def graph(kind, rng):
    name = lambda i: f"{(i * 7919) % 1009:04d}"
    e = []
    if kind == "shapes":
        e += [(name(i), name(i + 1)) for i in range(0, 70)]  # a path
        e += [(name(100 + i), name(100 + (i + 1) % 23)) for i in range(23)]  # a ring
        e += [(name(200), name(201 + i)) for i in range(40)]  # a star
        e += [(name(300), name(301))]  # a pair
        e += [(name(400 + i), name(400 + j)) for i in range(6) for j in range(i)]  # a clique
        e += [(name(405), name(500)), (name(500), name(501)), (name(501), name(402))]  # a chain between two of its vertices
        e += [(name(600), name(601)), (name(601), name(602)), (name(602), name(600)), (name(602), name(603))]  # a ring with a leaf
        e += [(name(700 + (i - 1) // 2), name(700 + i)) for i in range(1, 31)]  # a tree
    else:
        e += [(name(rng.randrange(300)), name(rng.randrange(300))) for _ in range(260)]
        e += [(name(400 + rng.randrange(30)), name(400 + rng.randrange(30))) for _ in range(90)]
    e += [tuple(reversed(x)) for x in e if rng.random() < 0.3] + [x for x in e if rng.random() < 0.2]
    e += [(None, "x"), ("x", None), ("lonely", "lonely")]
    rng.shuffle(e)
    return e


@pytest.mark.parametrize("kind", ["shapes", "random"])
def test_against_union_find(spark, kind):
    edges = graph(kind, random.Random(3))
    assert run(spark, [(a, b, 1, 2) for a, b in edges]) == brute(edges)


def test_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [("a", "a", 0, 0), (None, None, 0, 0)]) == {}
