import random

from storepulse.llm.components import connected_components


def brute(links):
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {(x, root(x)) for pair in links if pair[0] != pair[1] for x in pair}


def test_equals_union_find(spark):
    rng = random.Random(1)
    cases = [[(a, a + 1) for a in range(20)] + [(100, b) for b in range(101, 130)] + [(60, b) for b in range(40, 60)],
             [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(3, 3), (204, 205), (205, 204)]]
    for links in cases:
        found = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
        assert sorted(map(tuple, found)) == sorted(brute(links))


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
