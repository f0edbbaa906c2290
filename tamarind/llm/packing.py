"""Problem 8: filling containers of fixed capacity with documents.

Documents are dealt to shards by a hash of their id, so that every shard holds
a like mixture of sizes and a bounded number of them.  A shard is packed by bin
completion: branch and bound over the containers, around the largest document
left, over the fillings that no other dominates, in the order of the space they
lose, pruned by the space that may still be lost.  Best-fit solutions are the
first incumbents.  What lies in the ill-filled containers of all shards is
dealt and packed once more.

Sums that documents can reach are kept as bits of whole numbers, one bit for
each sum, so a filling of a wanted sum is enumerated without dead ends.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from random import Random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarind.session import cut, table

CAPACITY = 8192
#: Documents of a shard.
SHARD = 2_000
#: Containers filled below this share are emptied and packed again with those of the other shards.
ILL_FILLED = 0.98
#: Steps (sets of sums made, fillings judged) after which the search of one shard rests with its incumbent; None searches to the end.
EFFORT = 3_000_000
#: Fillings of all containers that are held at once where hardly any space may be lost; with more, containers are filled one after the other.
HELD = 20_000


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: positions of the items of each container."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (space left, container), ascending
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = bisect_left(room, (sizes[i], -1))
        if k == len(room):
            bins.append([i])
            insort(room, (capacity - sizes[i], len(bins) - 1))
        else:
            left, b = room.pop(k)
            bins[b].append(i)
            insort(room, (left - sizes[i], b))
    return bins


def least_containers(sizes: list[int], capacity: int) -> int:
    """Lower bound: items over half the capacity stand alone, the others fill what those leave."""
    ordered = sorted(sizes)
    sums = [0]
    for s in ordered:
        sums.append(sums[-1] + s)
    best, half = -(-sums[-1] // capacity), bisect_right(ordered, capacity // 2)
    for limit in sorted({0, *ordered[:half]}):
        # Items above capacity - limit share with none of limit or more; the others over half leave room for those.
        small, high = bisect_left(ordered, limit), bisect_right(ordered, capacity - limit)
        spare = (high - half) * capacity - (sums[high] - sums[half])
        best = max(best, len(ordered) - half + max(0, -(-(sums[half] - sums[small] - spare) // capacity)))
    # A document of over 1/(k+1) of the space leaves at most k - 1 like it beside it: it counts for its steps of 1/k.
    count = Counter(ordered)
    for k in range(1, 21):
        weight = sum(n * (s * k if (k + 1) * s % capacity == 0 else (k + 1) * s // capacity * capacity) for s, n in count.items())
        best = max(best, -(-weight // (k * capacity)))
    return best


class _Search:
    """The documents left of a shard, as counts of distinct sizes, and the fillings they allow."""

    def __init__(self, sizes: list[int], capacity: int, effort: int | None):
        self.left, self.capacity, self.effort, self.steps = Counter(sizes), capacity, effort, 0
        self.order = sorted(self.left)

    def tired(self) -> bool:
        return self.effort is not None and self.steps > self.effort

    def take(self, sizes: tuple[int, ...], n: int = 1) -> None:
        for s in sizes:
            if not self.left[s]:
                insort(self.order, s)
            self.left[s] -= n
            if not self.left[s]:
                del self.order[bisect_left(self.order, s)]

    def fillings(self, room: int, most_lost: int, largest: int | None = None) -> Iterator[tuple[int, tuple[int, ...]]]:
        """``(space lost, sizes)`` of every undominated filling of ``room`` that loses at most ``most_lost``, least lost first.

        With ``largest``, all fillings from documents no larger than that, dominated ones too.
        """
        usable = [(s, self.left[s]) for s in self.order[: bisect_right(self.order, room if largest is None else min(room, largest))]]
        reach, below = [1], (1 << (room + 1)) - 1
        for s, n in usable:
            sums, n, k = reach[-1], min(n, room // s), 1
            while n:
                k = min(k, n)
                sums |= (sums << (s * k)) & below
                n, k = n - k, 2 * k
            reach.append(sums)
        self.steps += len(reach)
        ends = reach[-1]
        while ends:
            top = ends.bit_length() - 1
            lost, ends = room - top, ends ^ (1 << top)
            if lost > most_lost:
                return
            # How many of each size, the largest first; only choices from which the sum can still be reached.
            stack = [(len(usable), top, ())]
            while stack and not self.tired():
                k, want, chosen = stack.pop()
                self.steps += 1
                if not want:
                    if largest is not None or not self.dominated(chosen, room, lost):
                        yield lost, chosen
                    continue
                while usable[k - 1][0] > want:
                    k -= 1
                s, n = usable[k - 1]
                for take in range(min(n, want // s) + 1):
                    if reach[k - 1] >> (want - take * s) & 1:
                        stack.append((k - 1, want - take * s, chosen + (s,) * take))

    def dominated(self, chosen: tuple[int, ...], room: int, lost: int) -> bool:
        """Whether a document left behind fits in the place of some of the chosen ones and is larger than they are together, or as large as several."""
        one, several = 0, 0
        for s in chosen:
            several |= one << s
            one |= (1 << s) | (one << s)
        self.steps += 1 + len(chosen)
        larger, spread = one << 1 if lost else 0, 1
        while spread < lost:
            k = min(spread, lost - spread)
            larger |= larger << k
            spread += k
        better = several | larger
        if not better:
            return False
        used = Counter(chosen)
        return any(better >> s & 1 and self.left[s] > used[s] for s in self.order[: bisect_right(self.order, room)])


def bin_completion(sizes: list[int], capacity: int = CAPACITY, effort: int | None = EFFORT) -> list[list[int]]:
    """Containers as lists of positions in ``sizes``; every size is from 0 to the capacity.

    With ``effort`` None the result has the least number of containers there is; a number rests the
    search after so many steps with the best solution so far, at worst that of best fit.
    """
    solid = [i for i, s in enumerate(sizes) if s > 0]
    found = best_fit([sizes[i] for i in solid], capacity)
    plan = _completed([sizes[i] for i in solid], capacity, [tuple(sizes[solid[k]] for k in b) for b in found], effort)
    places: dict[int, list[int]] = {}
    for i in reversed(solid):
        places.setdefault(sizes[i], []).append(i)
    out = [[places[s].pop() for s in b] for b in plan]
    hollow = [i for i, s in enumerate(sizes) if s <= 0]
    return [[*out[0], *hollow], *out[1:]] if out else [hollow] if hollow else []


def _completed(sizes: list[int], capacity: int, incumbent: list[tuple[int, ...]], effort: int | None) -> list[tuple[int, ...]]:
    """Aims at the lower bound first, then at ever more containers, up to one less than the incumbent has."""
    aim, rest, gap = least_containers(sizes, capacity), effort, 1
    while aim < len(incumbent):
        search = _Search(sizes, capacity, None if rest is None else rest // 2)
        found = _filled(search, aim * capacity - sum(sizes))
        if found is not None:
            return found
        if rest is not None:
            rest -= search.steps
        # A search that came to its end proves that one more is needed.
        aim, gap = (aim + gap, 2 * gap) if search.tired() else (aim + 1, gap)
    return incumbent


def _filled(search: _Search, may_lose: int) -> list[tuple[int, ...]] | None:
    """Containers that lose no more than ``may_lose`` in all; None if there are none or the search is tired."""
    if may_lose < search.order[0]:
        held = list(islice(_all_fillings(search, may_lose), HELD + 1))
        if len(held) <= HELD and not search.tired():
            return _covered(search, may_lose, held)
    # Per container: fillings tried around the largest document left, what is in it now, space that may be lost from it on.
    stack: list[list] = [[0, (), may_lose]]
    while stack and not search.tired():
        level = stack[-1]
        search.take(level[1], -1)
        level[1] = ()
        around = search.order[-1]
        search.take((around,))
        filling = next(islice(search.fillings(search.capacity - around, level[2]), level[0], None), None)
        search.take((around,), -1)
        if filling is None:
            stack.pop()
            continue
        level[0] += 1
        level[1] = (around, *filling[1])
        search.take(level[1])
        if not search.order:
            return [b[1] for b in stack]
        stack.append([0, (), level[2] - filling[0]])
    return None


def _all_fillings(search: _Search, may_lose: int) -> Iterator[tuple[int, tuple[int, ...]]]:
    """Every way to fill a container that loses at most ``may_lose``, each once, by its largest document."""
    for s in search.order[::-1]:
        search.take((s,))
        made = search.fillings(search.capacity - s, may_lose, s)
        first = next(made, None)  # the counts are read here
        search.take((s,), -1)
        if first is not None:
            yield first[0], (s, *first[1])
        yield from ((lost, (s, *f)) for lost, f in made)


def _covered(search: _Search, may_lose: int, held: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, ...]] | None:
    """As ``_filled``, choosing among all fillings at once; sets of fillings are bits of whole numbers.

    The next container is filled around the document with the fewest fillings left for each time it
    was found to have none.  After ever more dead ends the search begins anew with what it learnt.
    """
    using: dict[tuple[int, int], int] = {}  # (size, n): fillings that hold at least n documents of the size
    for k, (_, sizes) in enumerate(held):
        for s, n in Counter(sizes).items():
            for m in range(1, n + 1):
                using[s, m] = using.get((s, m), 0) | 1 << k
    missed: Counter = Counter()
    chance, patience, misses = Random(may_lose), 100, 0
    # Per container: fillings that are possible, those to try (last first), what is in it now, space that may be lost from it on.
    root = [(1 << len(held)) - 1, None, (), may_lose]
    stack = [list(root)]
    while stack and not search.tired():
        if misses > patience:
            for level in stack:
                search.take(level[2], -1)
            misses, patience, stack = 0, patience * 3 // 2, [list(root)]
        level = stack[-1]
        search.take(level[2], -1)
        level[2] = ()
        live, allowed = level[0], level[3]
        if level[1] is None:
            level[1], fewest = [], None
            for s in reversed(search.order):
                n = (live & using.get((s, 1), 0)).bit_count()
                if not n:
                    missed[s] += 1
                    level[1] = []
                    break
                few = 0 if n == 1 else n / (1 + missed[s])
                if fewest is None or few < fewest:
                    fewest, level[1] = few, [s]
            search.steps += 1 + (len(search.order) * (len(held) + 2_000) >> 14)
            if level[1]:
                bits, options = live & using[level[1][0], 1], []
                while bits:
                    options.append((bits & -bits).bit_length() - 1)
                    bits &= bits - 1
                level[1] = sorted(options, key=lambda k: (-held[k][0], chance.random()))
        while level[1] and held[level[1][-1]][0] > allowed:
            level[1].pop()
        if not level[1]:
            misses += 1
            stack.pop()
            continue
        lost, sizes = held[level[1].pop()]
        before = {s: search.left[s] for s in sizes}
        level[2] = sizes
        search.take(sizes)
        if not search.order:
            return [b[2] for b in stack]
        for s, n in before.items():
            for m in range(search.left[s] + 1, n + 1):
                live &= ~using.get((s, m), 0)
        stack.append([live, None, (), allowed - lost])
    return None


def _pack(frame: pd.DataFrame, capacity: int, effort: int | None) -> pd.DataFrame:
    frame = frame.sort_values(["tokens", "key", "piece_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    sizes = frame["tokens"].tolist()
    container, offset, filled = [0] * len(sizes), [0] * len(sizes), [0] * len(sizes)
    for b, items in enumerate(bin_completion(sizes, capacity, effort)):
        at = 0
        for i in items:
            container[i], offset[i] = b, at
            at += sizes[i]
        for i in items:
            filled[i] = at
    return frame.assign(bin=container, position=offset, filled=filled)


def packed(documents: DataFrame, *, key: str = "doc_id", tokens: str = "n_tokens", text: str | None = "text", capacity: int = CAPACITY, effort: int | None = EFFORT) -> DataFrame:
    """``(key, piece_no, tokens, container, position)``: every piece of every document with its container.

    A document longer than the capacity is cut into full pieces, each a container of its own, and a
    rest.  A null size is taken from the text's bytes and end token, else 0; sizes under 0 count as 0.
    Repeated rows are each packed.  Containers are named by round, shard and number.  ``effort`` bounds the
    search of a shard, never its documents; None searches each shard to the end.
    """
    size = F.col(tokens).cast("long")
    if text is not None and text in documents.columns:
        size = F.coalesce(size, F.octet_length(F.col(text)).cast("long") + 1)
    sized = documents.select(F.col(key).alias("key"), F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("n"))
    full = F.floor(F.col("n") / capacity) - F.when((F.col("n") > 0) & (F.col("n") % capacity == 0), 1).otherwise(0)
    pieces = sized.select("key", "n", F.explode(F.sequence(F.lit(0).cast("long"), full)).alias("piece_no")).select(
        "key", F.col("piece_no").cast("int").alias("piece_no"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece_no") * capacity).cast("int").alias("tokens"))
    kind = dict(documents.dtypes)[key]
    schema = f"key {kind}, piece_no int, tokens int, shard int, bin int, position int, filled int"

    def deal(items: DataFrame, salt: int) -> DataFrame:
        shards = max(1, -(-items.count() // SHARD))
        dealt = items.withColumn("shard", F.pmod(F.xxhash64("key", "piece_no", F.lit(salt), F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
        # Shards are few bytes but long work each: spread by count, not by size.
        dealt = dealt.repartition(min(shards, 4 * documents.sparkSession.sparkContext.defaultParallelism), "shard")
        return dealt.groupBy("shard").applyInPandas(lambda f: _pack(f, capacity, effort)[["key", "piece_no", "tokens", "shard", "bin", "position", "filled"]], schema)

    whole = pieces.where(F.col("tokens") == capacity)
    first = cut(deal(pieces.where(F.col("tokens") < capacity), 1))
    ill = first.where(F.col("filled") < int(ILL_FILLED * capacity))
    second = deal(ill.select("key", "piece_no", "tokens"), 2)
    name = lambda n: F.format_string("%d-%d-%d", F.lit(n), "shard", "bin")
    columns = [F.col("key").alias(key), "piece_no", "tokens"]
    return (
        first.where(F.col("filled") >= int(ILL_FILLED * capacity)).select(*columns, name(1).alias("container"), "position")
        .unionByName(second.select(*columns, name(2).alias("container"), "position"))
        .unionByName(whole.select(*columns, F.format_string("0-%s-%d", F.col("key").cast("string"), "piece_no").alias("container"), F.lit(0).alias("position")))
    )


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: their number, the tokens, the least number that could hold them, those above it, the unused share."""
    bins = packed(table(spark, sf_dir, "documents")).groupBy("container").agg(F.sum("tokens").alias("tokens"))
    total = bins.agg(F.count("*").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).withColumn("least_containers", F.ceil(F.col("tokens") / CAPACITY))
    return total.select("containers", "tokens", "least_containers", (F.col("containers") - F.col("least_containers")).alias("above_least"), F.round(1 - F.try_divide("tokens", F.col("containers") * CAPACITY), 6).alias("unused_share"))


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the containers hold of each document: pieces, tokens, and the largest piece."""
    return packed(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("tokens").cast("long").alias("largest"))


ORACLES = {
    "p8_pieces": """
        SELECT doc_id, sum(greatest(1, (n + 8191) // 8192))::BIGINT AS pieces, sum(n)::BIGINT AS tokens, max(least(n, 8192))::BIGINT AS largest
        FROM (SELECT doc_id, greatest(coalesce(n_tokens, octet_length(encode(text)) + 1, 0), 0)::BIGINT AS n FROM documents) GROUP BY doc_id""",
}
