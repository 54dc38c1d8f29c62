import random

import pytest

from vocaris.operators import graphs


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in parent}


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rnd = random.Random(seed)
    windows = [(r, i) for r in range(4) for i in range(20 + 30 * r)]
    edges = [(r, rnd.randrange(20 + 30 * r), rnd.randrange(20 + 30 * r)) for r in range(4) for _ in range(10 + 22 * r)]
    edges += [(3, i, i + 1) for i in range(60, 109)] + [(3, 5, 5)] + edges[:3]  # a long path, a loop, repeats
    got = graphs.components(spark.createDataFrame(windows, "rec long, i int"), spark.createDataFrame(edges, "rec long, i int, j int"))
    want = union_find(windows, [((r, i), (r, j)) for r, i, j in edges])
    assert {(r.rec, r.i): (r.rec, r.component) for r in got.collect()} == want


def test_recordings_without_edges_and_empty_tables(spark):
    windows, none = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "rec long, i int"), spark.createDataFrame([], "rec long, i int, j int")
    assert sorted(tuple(r) for r in graphs.connected(windows, none).collect()) == [(1, 2, 2, False), (2, 1, 1, True)]
    assert graphs.components(windows.limit(0), none).count() == 0


def test_least_connecting_equals_trying_every_count(spark):
    rnd = random.Random(9)
    rows = [(r, i, j, round(rnd.random(), 1)) for r in range(3) for i in range(6 + 8 * r) for j in range(6 + 8 * r)] + [(9, 0, 0, 1.0)]
    got = {r.rec: r.p for r in graphs.least_connecting(spark.createDataFrame(rows, "rec long, i int, j int, w double")).collect()}
    want = {}
    for rec in (0, 1, 2, 9):
        own = [x for x in rows if x[0] == rec]
        nodes = {x[1] for x in own}
        for p in range(1, 100):
            kept = [(i, j) for i in nodes for _, _, j, _ in sorted((x for x in own if x[1] == i), key=lambda x: (-x[3], -x[2]))[:p]]
            if len(set(union_find(nodes, kept).values())) == 1:
                want[rec] = p
                break
    assert got == want and len(set(want.values())) > 1
