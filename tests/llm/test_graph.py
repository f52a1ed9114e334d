"""Components against union-find."""

import random

from lodestrata.llm.graph import components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


def test_components(spark):
    rnd = random.Random(3)
    cases = [
        [(i, i + 1) for i in range(60)],
        [(0, i) for i in range(1, 300)] + [(5, 5), (0, 1), (1, 0)],
        [(rnd.randrange(-150, 150), rnd.randrange(-150, 150)) for _ in range(120)],

        [],
        [(7, 7)],
    ]
    for edges in cases:
        got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == brute(edges)
