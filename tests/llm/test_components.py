import random

from tillwatch.llm.components import components


def test_against_union_find(spark):
    rnd = random.Random(7)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in pairs:
        x, y = find(a), find(b)
        if a != b:
            parent[max(x, y)] = min(x, y)
    want = {(n, find(n)) for a, b in pairs if a != b for n in (a, b)}
    got = components(spark.createDataFrame(pairs, "a long, b long").repartition(3)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
