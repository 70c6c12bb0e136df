"""Core numbers of all nodes."""

from itertools import combinations

from quarrystat.operators import graph, models


def peel(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out, k = {}, 0
    while near:
        k = max(k, min(map(len, near.values())))
        while low := [x for x in near if len(near[x]) <= k]:
            for x in low:
                out[x] = k
                for y in near.pop(x):
                    if y in near:
                        near[y].discard(x)
    return out


def test_core_numbers(spark, sf):
    edges = [*combinations(range(7), 2), *combinations(range(10, 14), 2), (6, 10), (13, 20), (20, 21), (21, 6), (30, 31)]
    got = {r.node: r.core for r in graph.core_numbers(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == peel(edges) and max(got.values()) == 6
    want = peel([(r.src, r.dst) for r in graph._supply(spark, sf).collect()])
    rows = models._shells(spark, sf).collect()
    assert {r.k: r.shell for r in rows} == {k: list(want.values()).count(k) for k in set(want.values())}
    assert {r.max_core for r in rows} == {max(want.values())} and max(r.nodes for r in rows) == len(want)
