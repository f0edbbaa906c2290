import random

import pytest

from tamarind.llm.components import connected_groups
from tamarind.operators import groups


def brute(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a and b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in up}


def run(spark, edges):
    df = spark.createDataFrame([(a, b, "x") for a, b in edges], "record_a string, record_b string, v string")
    rows = [tuple(r) for r in connected_groups(df).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_small_cases(spark):
    assert run(spark, []) == set()
    assert run(spark, [("a", "a"), ("b", None), (None, None), ("", "c")]) == {("a", "a")}
    assert run(spark, [("b", "a"), ("a", "b"), ("a", "b")]) == {("a", "a"), ("b", "a")}


@pytest.mark.parametrize("hot", [50_000, 5])
def test_shapes_against_union_find(spark, monkeypatch, hot):
    monkeypatch.setattr(groups, "HOT_ROWS", hot)
    monkeypatch.setattr(groups, "HOT_KEYS", 20)
    r = random.Random(3)
    order = list(range(40))
    r.shuffle(order)
    edges = [(f"k{i:02}", f"k{(i + 1) % 24:02}") for i in range(24)]
    edges += [(f"p{order[i]}", f"p{order[i + 1]}") for i in range(39)]
    edges += [(f"c{i}", f"c{j}") for i in range(7) for j in range(i)] + [("c0", "t1"), ("t1", "t2"), ("t2", "c3")]
    edges += [("hub", f"h{i}") for i in range(40)] + [(f"r{r.randrange(50)}", f"r{r.randrange(50)}") for _ in range(60)]
    assert run(spark, edges) == brute(edges)
