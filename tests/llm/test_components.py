import random

import pytest

from wattloom.llm.components import connected_components, spanning_forest


def brute(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("links", [
    [], [(1, 1), (None, 2), (3, None)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(5, 2), (2, 5), (5, 2), (9, 8)],
    [(random.Random(1).randrange(200), random.Random(i).randrange(200)) for i in range(90)],
])
def test_matches_union_find(spark, links):
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == brute(links) and len(got) == len(brute(links))
    for per_task in (1, 1 << 18):
        kept = [(r["a"], r["b"]) for r in spanning_forest(spark.createDataFrame(links, "a long, b long").repartition(5), per_task).collect()]
        joined = {x: c for x, c in brute(links).items() if any(c == d and x != y for y, d in brute(links).items())}
        assert brute(kept) == joined and set(kept) <= set(links)
    assert len(kept) == len(joined) - len(set(joined.values()))
