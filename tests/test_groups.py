import random

import pytest

from tamarind.operators import groups


def brute(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in up}


@pytest.mark.parametrize("hot", [50_000, 5])
def test_components_against_union_find(spark, monkeypatch, hot):
    monkeypatch.setattr(groups, "HOT_ROWS", hot)
    monkeypatch.setattr(groups, "HOT_KEYS", 20)
    r = random.Random(5)
    edges = [(0, k) for k in range(1, 40)] + [(100 + k, 101 + k) for k in range(15)] + [(200, 200), (None, 7), (3, None)] + [(r.randrange(300, 350), r.randrange(300, 350)) for _ in range(40)]
    df = spark.createDataFrame(edges, "u long, w long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = [tuple(r) for r in groups.connected(df).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(edges)
    assert groups.connected(df.limit(0)).count() == 0 and spark.conf.get("spark.sql.shuffle.partitions") == before
