"""Connected groups of an undirected graph by alternating star steps, and joins that bear hot keys."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tamarind.session import cut

#: A key is hot with more rows than this, and than one row of HOT_KEYS: there are then at most HOT_KEYS hot keys, which are broadcast.
HOT_ROWS, HOT_KEYS = 50_000, 10_000
#: Edges of a shuffle partition.
EDGES_PER_PARTITION = 500_000


def measured(df: DataFrame, *figures: Column) -> tuple[DataFrame, dict]:
    """``df`` checkpointed, and figures over its rows taken in the same job."""
    seen = Observation()
    made = cut(df.observe(seen, F.count(F.lit(1)).alias("rows"), *figures))
    return made, seen.get


@contextmanager
def partitions_for(df: DataFrame, rows: int):
    """Shuffles of the jobs run inside are cut for so many rows, not for the session's tables."""
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.shuffle.partitions")
    conf.set("spark.sql.shuffle.partitions", str(max(4, -(-rows // EDGES_PER_PARTITION))))
    try:
        yield
    finally:
        conf.set("spark.sql.shuffle.partitions", before)


def looked_up(rows: DataFrame, values: DataFrame, on: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with a table that holds each key ``on`` at most once.

    The rows of a hot key stay where they are and meet its value by a broadcast of at most
    ``HOT_KEYS`` rows; all others are shuffled.
    """
    if total <= HOT_ROWS:
        return rows.join(values, on, how)
    hot = rows.groupBy(on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(HOT_ROWS, total // HOT_KEYS)).select(on, F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(hot), on, "left")
    there = marked.where("_hot").drop("_hot").join(F.broadcast(values.join(F.broadcast(hot.select(on)), on, "left_semi")), on, how)
    return there.unionByName(marked.where("_hot is null").drop("_hot").join(values, on, how))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("w").alias("n")), F.struct(F.col("w").alias("v"), F.col("u").alias("n")))).alias("e")).select("e.*")


def canonical(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges u < w without loops."""
    return edges.where("u <> w").select(F.least("u", "w").alias("u"), F.greatest("u", "w").alias("w")).distinct()


def star_labels(edges: DataFrame, total: int) -> DataFrame:
    """``(v, label)`` of all but the least vertex of each component, by large-star and small-star steps over ``total`` edges u < w."""
    state, before = edges, None
    while True:
        # large-star: greater neighbours of each vertex to its least neighbour or itself
        both = both_ways(state)
        least = both.groupBy("v").agg(F.least(F.min("n"), F.first("v")).alias("m"))
        large = looked_up(both.where("n > v"), least, "v", total).select(F.col("n").alias("u"), F.col("m").alias("w"))
        # small-star: smaller neighbours and itself to the least of them
        down = canonical(large).select(F.col("w").alias("v"), F.col("u").alias("n"))
        low = down.groupBy("v").agg(F.min("n").alias("m"))
        small = looked_up(down, low, "v", total).select(F.col("n").alias("u"), F.col("m").alias("w")).unionByName(low.select(F.col("v").alias("u"), F.col("m").alias("w")))
        # Settled when nothing changes any more, told by a digest free of order.
        state, figures = measured(canonical(small), F.bit_xor(F.xxhash64("u", "w")).alias("x"), F.sum(F.hash("u", "w").cast("long")).alias("s"))
        if figures == before:
            return state.select(F.col("w").alias("v"), F.col("u").alias("label"))
        before, total = figures, figures["rows"]


def connected(edges: DataFrame) -> DataFrame:
    """``(v, g)`` of every vertex of edges ``(u, w)``: ``g`` is the least vertex of its component.

    Null ends tie nothing, an edge to oneself makes a component of one, repeated and turned edges count once.
    """
    whole = edges.where("u is not null and w is not null").select("u", "w")
    pairs, figures = measured(whole.select(F.least("u", "w").alias("u"), F.greatest("u", "w").alias("w")).distinct())
    vertices = both_ways(pairs).select("v").distinct()
    if not figures["rows"]:
        return vertices.select("v", F.col("v").alias("g"))
    with partitions_for(edges, 2 * figures["rows"]):
        labels = star_labels(pairs.where("u <> w"), figures["rows"])
    return vertices.join(labels, "v", "left").select("v", F.coalesce("label", "v").alias("g"))
