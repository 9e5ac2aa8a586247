import random

from coincide.llm.components import components


def test_chains_stars_and_cycles(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 202), (202, 200), (7, 7), (-5, 60)]
    edges += [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(25)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(edges + edges[:20], "a bigint, b bigint")
    found = {r.node: r.root for r in components(frame).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert found == {x: find(x) for x in nodes}
    assert components(frame.limit(0)).count() == 0
