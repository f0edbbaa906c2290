"""Keyed merges of evidence: records by column policy, events and payloads once, links with counters, sightings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarind.functions.frames import frame

#: What a merge keeps of a column: the last array that is not empty, the greatest value, the first that is not null; of all others the last value that is not null.
FILLED = "matched_keywords media hashtags".split()
GREATEST = "match_score captured_at sightings".split()
FIRST = "platform post_id created_at".split()
#: Made by the merge itself, and added up, or kept, when its result is merged again.
COUNTED = "capture_count first_seen first_payload_hash".split()


def merged_records(rows: DataFrame, key: str = "key", order: list[str] | None = None) -> DataFrame:
    """One row per key in the order of arrival, with all columns of ``rows`` and the counters of ``COUNTED``.

    A partial aggregation before the shuffle merges within a task, so a key with many copies costs
    one row per task.  Null keys are dropped.  Rows may themselves be merged ones: counts add up.
    """
    have, order = set(rows.columns), order or [c for c in ("captured_at", "payload_hash") if c in rows.columns]
    at = F.struct(*(F.col(c) for c in order))
    last = [c for c in rows.columns if c not in {key, *FILLED, *GREATEST, *FIRST, *COUNTED, *(c for c in order if c.startswith("_"))}]
    made = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in last]
    made += [F.max_by(c, F.when(F.size(c) > 0, at)).alias(c) for c in FILLED if c in have]
    made += [F.max(c).alias(c) for c in GREATEST if c in have]
    made += [F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in FIRST if c in have]
    if "payload_hash" in have:
        digest = F.coalesce(*(F.col(c) for c in ("first_payload_hash", "payload_hash") if c in have))
        made.append(F.min_by(digest, F.when(digest.isNotNull(), at)).alias("first_payload_hash"))
    count = F.sum(F.coalesce("capture_count", F.lit(1).cast("long"))) if "capture_count" in have else F.count("*")
    seen = F.coalesce("first_seen", "captured_at") if "first_seen" in have else F.col("captured_at")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*made, count.alias("capture_count"), F.min(seen).alias("first_seen"))


def upserted(current: DataFrame, arrived: DataFrame, key: str = "key") -> DataFrame:
    """The merge of a stored table with a batch; the batch counts as later."""
    both = current.withColumn("_late", F.lit(0)).unionByName(arrived.withColumn("_late", F.lit(1)), allowMissingColumns=True)
    return merged_records(both, key, ["_late", "captured_at"])


def appended(stored: DataFrame, arrived: DataFrame, on: list[str], first_by: list[str]) -> DataFrame:
    """The stored rows and those of a batch whose identity was not stored yet; an append that may be run again."""
    return stored.unionByName(new_only(stored, arrived, on, first_by), allowMissingColumns=True)


def merged_state(stored: DataFrame, arrived: DataFrame, on: list[str]) -> DataFrame:
    """A keyed state after a batch: keys of either side once, values of the batch where it has one, else the stored ones.

    Adds ``change``: ``inserted``, ``updated``, ``kept`` (in both, nothing differs) or ``missing`` (not in the batch).
    Each side holds a key at most once; null keys are equal to nulls.
    """
    values = [c for c in stored.columns if c not in on]
    s, a = stored.alias("s"), arrived.alias("a")
    held, came = s.withColumn("_s", F.lit(True)).alias("s"), a.withColumn("_a", F.lit(True)).alias("a")
    joined = held.join(came, [F.col(f"s.{c}").eqNullSafe(F.col(f"a.{c}")) for c in on], "full")
    both = F.col("_s").isNotNull() & F.col("_a").isNotNull()
    differs = reduce(lambda x, y: x | y, [F.col(f"a.{c}").isNotNull() & ~F.col(f"a.{c}").eqNullSafe(F.col(f"s.{c}")) for c in values], F.lit(False))
    change = F.when(F.col("_s").isNull(), "inserted").when(F.col("_a").isNull(), "missing").when(both & differs, "updated").otherwise("kept")
    return joined.select(*(F.when(F.col("_s").isNull(), F.col(f"a.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in on), *(F.coalesce(f"a.{c}", f"s.{c}").alias(c) for c in values), change.alias("change"))


def new_only(stored: DataFrame, arrived: DataFrame, on: list[str], first_by: list[str]) -> DataFrame:
    """Rows of a batch whose identity is not stored yet, the first of each identity; nulls are equal to nulls."""
    w = Window.partitionBy(*on).orderBy(*first_by)
    first = arrived.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    known = stored.select(*(F.col(c).alias(f"_{c}") for c in on))
    return first.join(known, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on], "left_anti")


def sightings(events: DataFrame, key: str = "record_key", digest: str = "payload_hash", context: str = "context", order: tuple[str, ...] = ("captured_at", "id")) -> DataFrame:
    """Each sighting as ``new``, ``changed``, ``new_context`` or ``repeat`` against those before it.

    A sighting is changed unless its digest is that of the one before; else it repeats where its
    context was seen before.  Two windows over hash partitions; a null digest counts as changed.
    """
    w = Window.partitionBy(key).orderBy(*order)
    seen = Window.partitionBy(key, context).orderBy(*order)
    made = events.withColumn("_n", F.row_number().over(w)).withColumn("_before", F.lag(digest).over(w)).withColumn("_seen", F.row_number().over(seen) > 1)
    decision = F.when(F.col("_n") == 1, "new").when(F.coalesce(F.col("_before") != F.col(digest), F.lit(True)), "changed").when(F.col("_seen"), "repeat").otherwise("new_context")
    return made.withColumn("decision", decision).drop("_n", "_before", "_seen")


def after(rows: DataFrame, order: list[str], last: tuple | None, page: int) -> DataFrame:
    """The next page of rows behind the ``last`` values of ``order``, read by key and not by offset; ``page`` from 1 to 1 000."""
    if not 1 <= page <= 1_000:
        raise ValueError("a page holds 1 to 1 000 rows")
    if last is not None:
        rows = rows.where(F.struct(*order) > F.struct(*(F.lit(v).alias(c) for c, v in zip(order, last))))
    return rows.orderBy(*order).limit(page)


def purged(rows: DataFrame, time: str, before: Column, guards: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Rows that stay and keys that go: a key goes if its last row is older than ``before`` and it is not among ``guards``."""
    old = rows.groupBy(key).agg(F.max(time).alias("_last")).where(F.col("_last") < before).select(key)
    gone = old.join(guards.select(key).distinct(), key, "left_anti")
    return rows.join(gone, key, "left_anti"), gone


def latest(rows: DataFrame, by: list[str], order: list[Column], keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of each group; the limit is pushed below the shuffle by the planner."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= keep).drop("_n")


def running_total(rows: DataFrame, order: str, value: str, block: int = 4096) -> DataFrame:
    """Adds ``running``, the sum of ``value`` over all rows up to each in the order of a whole-number column.

    Blocks of the order column are summed first and their sums added up, one row a block, so no task
    sees all rows.
    """
    blocks = rows.withColumn("_b", F.floor(F.col(order) / block))
    sums = blocks.groupBy("_b").agg(F.sum(value).alias("_s"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inside = F.sum(value).over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("_in", inside).join(before, "_b").withColumn("running", F.coalesce(F.col("_in"), F.lit(0)) + F.col("_before")).drop("_b", "_in", "_before")


def pushes(rows: DataFrame, queue: str, order: list[str], size: str, most_bytes: int = 4_000_000, most_rows: int = 25) -> DataFrame:
    """Adds ``push``, the number from 1 of the push that takes each row in its queue, ``running``, the bytes of the push so far, and ``too_large``.

    A push takes rows in order until the next would exceed its rows or bytes; that row opens the next
    push.  Rows larger than any push are flagged, have no push and hold up no other.  Queues are read
    as sorted streams, so a long one costs no memory.
    """
    kinds = dict(rows.dtypes)
    names, times = rows.columns, [c for c, k in kinds.items() if k == "timestamp"]  # times go as whole numbers, whatever the session's zone

    def plan(batches):
        at, push, n, running = None, 0, 0, 0
        for b in batches:
            made: list = []
            for q, k in zip(b[queue].tolist(), b[size].tolist()):
                if q != at:
                    at, push, n, running = q, 0, 0, 0
                if k > most_bytes:
                    made.append((None, None, True))
                    continue
                if not push or n >= most_rows or running + k > most_bytes:
                    push, n, running = push + 1, 0, 0
                n, running = n + 1, running + k
                made.append((push, running, False))
            yield frame(**{c: b[c].tolist() for c in names}, push=[m[0] for m in made], running=[m[1] for m in made], too_large=[m[2] for m in made])

    schema = ", ".join([*(f"`{c}` {'long' if c in times else kinds[c]}" for c in names), "push long, running long, too_large boolean"])
    queued = rows.where(F.col(queue).isNotNull() & F.col(size).isNotNull()).withColumns({c: F.unix_micros(c) for c in times})
    made = queued.repartition(queue).sortWithinPartitions(queue, *order).mapInPandas(plan, schema)
    return made.withColumns({c: F.timestamp_micros(c) for c in times})
