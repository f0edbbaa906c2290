import random
import time

import numpy as np

from tamarind.llm import leakage
from tamarind.llm.fmindex import FMIndex, suffix_array
from tamarind.llm.leakage import leaked_passages, signs_of

ITEM = "An annotator asked whether the Souansavankang advert quoting 747 rai and 76 wa counts as bare land or as a house plot beside Paksisoung. Whenever a writer states a depth of 579 metres, mark a conflict"


def test_suffix_array_and_search_against_brute_force():
    r = np.random.default_rng(5)
    x = np.append(r.integers(1, 4, 3000), 0)
    x[500:900] = x[1500:1900]
    sa = suffix_array(x)
    tail = x.astype(np.uint8).tobytes()
    assert sorted(range(len(x)), key=lambda i: tail[i:]) == sa.tolist()
    index = FMIndex(x)
    phrases = np.array([x[i : i + 25] for i in (0, 520, 1520, 2900)] + [r.integers(1, 4, 25)])
    low, high = index.search(phrases)
    for p, l, h in zip(phrases, low, high):
        want = {i for i in range(len(x) - 25) if (x[i : i + 25] == p).all()}
        assert set(index.locate(np.arange(l, h)).tolist()) == want


def brute(docs, items):
    grams = {}
    for i, t in items:
        s = signs_of(t)
        for o in range(len(s) - leakage.PASSAGE + 1):
            grams.setdefault(s[o : o + leakage.PASSAGE], set()).add(i)
    return {(d, i) for d, t in docs if t for s in [signs_of(t)] for o in range(len(s)) for i in grams.get(s[o : o + leakage.PASSAGE], ())}


def test_leaks_and_spans(spark):
    r = random.Random(2)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    quote = ITEM[30:110]
    docs = [(1, noise(300) + quote.upper().replace(" ", "  ") + noise(50)), (2, noise(100) + ITEM[:40]), (3, None), (4, ""), (5, ITEM), (6, ITEM[:70] + noise(20) + ITEM[100:180]), (1, noise(20)), (7, noise(3000))]
    items = [(10, ITEM), (11, "short"), (10, ITEM), (12, ITEM[60:] + " another ending that goes on for quite a while longer than the rest"), (None, ITEM), (13, None)]
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string")
    rows = leaked_passages(d, i).collect()
    assert {(x[0], x[1]) for x in rows} == brute(docs, [x for x in items if x[0] and x[1]])
    span = next(x for x in rows if x[0] == 1 and x[1] == 10)
    assert signs_of(docs[0][1][span[2] : span[3]]).startswith(signs_of(quote)[:40])
    assert leaked_passages(d, i.limit(0)).count() == 0 and leaked_passages(d.limit(0), i).count() == 0


def test_long_texts_are_cut_without_loss(monkeypatch, spark):
    monkeypatch.setattr(leakage, "SHARD", 1000)
    blocks = leakage.ItemBlocks([(1, ITEM)])
    s = signs_of("q" * 950 + ITEM + "q" * 5000 + ITEM)
    shards = list(leakage._shards([s], blocks.longest + 1))
    assert all(sum(len(p) + 1 for *_, p in x) <= 1001 for x in shards)
    found = sum(len(blocks.passages(np.concatenate([np.append(p, 0) for *_, p in x]).astype(np.uint32))) > 0 for x in shards)
    assert found >= 2


def test_repeated_signs():
    blocks = leakage.ItemBlocks([(1, "k" * 2_000), (2, "ha" * 300)])
    text = np.concatenate([leakage._codes("k" * 20_000), [0], leakage._codes("x" + "ha" * 400), [0]]).astype(np.uint32)
    began = time.perf_counter()
    assert blocks.passages(text).tolist() == [[0, 0, 20_000], [1, 20_002, 20_802]]
    assert time.perf_counter() - began < 5
