import random
from itertools import combinations

import pytest

from tamarind.llm.packing import CAPACITY, _Search, best_fit, bin_completion, least_containers, packed


def optimum(sizes, capacity):
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms)}.values():
            if rooms[k] >= sizes[i]:
                go(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(25))
def test_against_exhaustive_search(seed):
    r = random.Random(seed)
    sizes = [r.randint(15, 60) for _ in range(9)]
    made = bin_completion(sizes, 100, None)
    assert sorted(sum(made, [])) == list(range(9)) and all(sum(sizes[i] for i in b) <= 100 for b in made)
    assert least_containers(sizes, 100) <= optimum(sizes, 100) <= len(made) <= len(best_fit(sizes, 100))
    assert len(made) == optimum(sizes, 100)


def test_completion_beats_best_fit():
    sizes = [44, 36, 33, 31, 29, 27, 24, 22, 20, 18, 16]  # 300 in all: three full containers exist
    assert len(bin_completion(sizes, 100)) == 3


def triples(n, capacity, seed):
    """Sizes between a quarter and a half of the capacity of which three fill each of ``n`` containers exactly."""
    r, out = random.Random(seed), []
    while len(out) < 3 * n:
        a, b = r.randint(capacity // 4 + 1, capacity // 2 - 1), r.randint(capacity // 4 + 1, capacity // 2 - 1)
        if capacity // 4 < capacity - a - b < capacity // 2:
            out += [a, b, capacity - a - b]
    return out


@pytest.mark.parametrize(("n", "capacity", "seed"), [(20, CAPACITY, 0), (20, CAPACITY, 1), (60, 1000, 0), (60, 1000, 1), (60, 1000, 2)])
def test_exact_triples(n, capacity, seed):
    sizes = triples(n, capacity, seed)
    made = bin_completion(sizes, capacity, None)
    assert len(best_fit(sizes, capacity)) > n == len(made)
    assert sorted(sum(made, [])) == list(range(3 * n)) and all(sum(sizes[i] for i in b) <= capacity for b in made)


@pytest.mark.parametrize(("sizes", "want"), [([2] * 1100 + [2731] * 900, 450), ([0] * 1100 + [2731] * 900, 450), ([1] * 2000, 1), ([0] * 5, 1), ([], 0), ([CAPACITY] * 3, 3), ([4097] * 7 + [4095] * 7, 7)])
def test_many_equal_documents(sizes, want):
    made = bin_completion(sizes)
    assert len(made) == want == least_containers(sizes, CAPACITY) or not any(sizes)
    assert len(made) == want and sorted(sum(made, [])) == list(range(len(sizes)))


def test_fillings_are_complete():
    sizes = sorted([5, 8, 13, 21, 34, 8])
    search = _Search(sizes, 40, None)
    some = {tuple(sorted(f)) for _, f in search.fillings(40, 40, 40)}
    assert some == {tuple(sorted(sizes[k] for k in c)) for n in range(7) for c in combinations(range(6), n) if sum(sizes[k] for k in c) <= 40}
    kept = list(search.fillings(40, 40))
    assert [lost for lost, _ in kept] == sorted(lost for lost, _ in kept) and kept[0][0] == min(40 - sum(f) for f in some)
    for f in some:  # every filling left out can be bettered by one that stays
        assert any(lost <= 40 - sum(f) for lost, _ in kept)


def test_query(spark):
    r = random.Random(1)
    rows = [(i, r.randint(1, 6000), "x", "c") for i in range(500)] + [(900, 3 * CAPACITY, "x", "c"), (901, 2 * CAPACITY + 5, "x", "c"), (902, None, "abc", "c"), (903, 0, "x", "c"), (904, -5, "x", "c"), (905, CAPACITY, "x", "c"), (0, 7, "x", "c")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int, text string, container string")
    got = packed(df).toPandas()
    assert got.tokens.sum() == sum(max(n or 0, 0) for _, n, _, _ in rows) + 4
    assert got.groupby("container").tokens.sum().max() <= CAPACITY
    assert (got[got.doc_id == 900].tokens == CAPACITY).all() and len(got[got.doc_id == 900]) == 3
    assert sorted(got[got.doc_id == 901].tokens) == [5, CAPACITY, CAPACITY]
    assert len(got[got.doc_id == 0]) == 2 and len(got[(got.doc_id < 900) & (got.piece_no > 0)]) == 0
    assert got.container.nunique() <= -(-got.tokens.sum() // CAPACITY) + 2
    assert packed(df.limit(0)).count() == 0
    one = packed(spark.createDataFrame([(1, 10, "x", "c")] * 50, df.schema))
    assert one.count() == 50 and one.select("container").distinct().count() == 1
