import random

from changelens.llm.common import components


def test_chains_stars_and_random_graphs(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(7, 7), (None, 3), (9, 8), (8, 9)]
    root = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    want = {x: find(x) for e in edges if None not in e and e[0] != e[1] for x in e}
    got = [tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert len(got) == len(want) and dict(got) == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
