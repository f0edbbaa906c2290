"""Problem 5: pairwise matches consolidated into groups.

Records are numbered once in byte order, so that all rounds move whole numbers.
The graph is reduced before it is solved: vertices with one neighbour are
stripped, chains of vertices with two neighbours are compressed to one edge by
list ranking (pointer doubling), again and again while that still removes a
fair share of the vertices.  What is left is solved by alternating large-star
and small-star steps.  Removed vertices point to a vertex that stayed longer,
so their labels come back by following pointers.

No step brings all rows of a hub or of a giant group into one task: counts and
least neighbours are partly aggregated, removals are matched by both ends of an
edge, and labels come back through ``looked_up``, which broadcasts hot keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarind.operators.groups import both_ways, canonical, looked_up, measured, partitions_for, star_labels
from tamarind.session import cut, table

#: Reduction goes on while a round removes at least this share of the vertices.
WORTHWHILE = 0.05


def _strip_leaves(edges: DataFrame, deg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove all vertices of degree one; of an edge on its own the greater end is the leaf."""
    leaves = deg.where("deg = 1").select(F.least("v", "lo").alias("u"), F.greatest("v", "lo").alias("w"), F.col("v").alias("leaf"))
    per = cut(edges.select("u", "w", F.lit(None).cast("long").alias("leaf")).unionByName(leaves).groupBy("u", "w").agg(F.max("leaf").alias("leaf")))
    pointers = per.where("leaf is not null").select(F.col("leaf").alias("child"), F.when(F.col("leaf") == F.col("w"), F.col("u")).otherwise(F.col("w")).alias("parent"))
    return pointers, per.where("leaf is null").select("u", "w")


def _compress_chains(edges: DataFrame, deg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace maximal chains of inner vertices of degree two by one edge between their ends.

    A list element is an inner vertex together with a direction; its successor is the next inner
    vertex in that direction.  Doubling the successor ranks every element to the end of its chain
    in logarithmically many steps.  A vertex of degree two that is less than both neighbours stays
    as an end, so that every ring has one; it goes in a later round.
    Returns the pointers to the nearer end and the edges that are left.
    """
    inner = deg.where("deg = 2 and not (v < lo)").select("v", "lo", "hi")
    steps = inner.select("v", F.explode(F.array(F.struct(F.col("lo").alias("back"), F.col("hi").alias("to")), F.struct(F.col("hi").alias("back"), F.col("lo").alias("to")))).alias("s")).select("v", "s.*")
    # An element (v, back) walks on to (to, v) where `to` is an inner vertex and so has an element of its own, else it ends at `to`.
    goes_on = steps.select(F.col("back").alias("v"), F.col("v").alias("to"), F.lit(True).alias("goes_on"))
    first = steps.join(goes_on, ["v", "to"], "left").select("v", "back", F.col("to").alias("at"), F.col("v").alias("via"), F.coalesce("goes_on", F.lit(False)).alias("open"), F.lit(1).cast("long").alias("rank"))
    state, figures = measured(first, F.count_if("open").alias("more"))
    while figures["more"]:
        nxt = state.select(F.col("v").alias("at"), F.col("back").alias("via"), F.col("at").alias("at2"), F.col("via").alias("via2"), F.col("open").alias("open2"), F.col("rank").alias("rank2"))
        done, more = state.where("not open"), state.where("open")
        further = done.unionByName(more.join(nxt, ["at", "via"]).select("v", "back", F.col("at2").alias("at"), F.col("via2").alias("via"), F.col("open2").alias("open"), (F.col("rank") + F.col("rank2")).alias("rank")))
        state, figures = measured(further, F.count_if("open").alias("more"))
    per = cut(state.groupBy("v").agg(F.min(F.struct("rank", "at")).alias("near"), F.min("at").alias("a"), F.max("at").alias("b")))
    gone = steps.select(F.least("v", "to").alias("u"), F.greatest("v", "to").alias("w")).distinct()
    made = per.where("near.rank = 1").select(F.col("a").alias("u"), F.col("b").alias("w"))
    return per.select(F.col("v").alias("child"), F.col("near.at").alias("parent")), canonical(edges.join(gone, ["u", "w"], "left_anti").unionByName(made))


def _root_of_each(live: DataFrame, total: int) -> DataFrame | None:
    """``(child, parent)`` with the root of every vertex that is not its own; None without edges."""
    pointers = []
    while True:
        degrees = both_ways(live).groupBy("v").agg(F.count(F.lit(1)).alias("deg"), F.min("n").alias("lo"), F.max("n").alias("hi"))
        deg, counts = measured(degrees, F.count_if(F.expr("deg = 1")).alias("leaves"), F.count_if(F.expr("deg = 2 and not (v < lo)")).alias("chained"))
        left, leaves, chained = counts["rows"], counts["leaves"], counts["chained"]
        if leaves >= max(1, WORTHWHILE * left, chained):
            p, live = _strip_leaves(live, deg)
        elif chained >= max(1, WORTHWHILE * left):
            p, rest = _compress_chains(live, deg)
            live = cut(rest)
        else:
            break
        pointers.append(p)
    if left:
        pointers.append(star_labels(live, total).select(F.col("v").alias("child"), F.col("label").alias("parent")))
    if not pointers:
        return None
    # Each pointer leads to a vertex that was removed in a later round: halve the ways until all reach a root.
    up, rounds = reduce(DataFrame.unionByName, pointers), len(pointers)
    while rounds > 1:
        far = up.select(F.col("child").alias("parent"), F.col("parent").alias("far"))
        up = cut(looked_up(up, far, "parent", total, "left").select("child", F.coalesce("far", "parent").alias("parent")))
        rounds = (rounds + 1) // 2
    return up


def connected_groups(edges: DataFrame, a: str = "record_a", b: str = "record_b") -> DataFrame:
    """``(record_key, group_key)`` of every record of an edge with both ends.

    ``group_key`` is the least key of the group in byte order.  Edges with a null or empty end tie
    nothing; an edge to oneself makes a group of one; repeated and turned edges count once; other
    columns are not read; an empty table gives an empty result.
    """
    whole = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> '' and b <> ''")
    named, figures = measured(whole.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    total = figures["rows"]
    if not total:
        return named.select(F.col("a").alias("record_key"), F.col("b").alias("group_key"))
    with partitions_for(edges, 2 * total):
        keys = named.select(F.explode(F.array("a", "b")).alias("key")).distinct().sort("key")
        keys = cut(keys.select("key", F.monotonically_increasing_id().alias("v")))  # numbers rise with the keys
        apart = named.where("a <> b")
        apart = looked_up(apart, keys.select(F.col("key").alias("a"), F.col("v").alias("u")), "a", total).select("u", "b")
        live = cut(looked_up(apart, keys.select(F.col("key").alias("b"), F.col("v").alias("w")), "b", total).select("u", "w"))
        up = _root_of_each(live, total)
        if up is None:
            return keys.select(F.col("key").alias("record_key"), F.col("key").alias("group_key"))
        # A root points to none, so it is not among the children; its group's least key may be any member.
        rooted = cut(keys.join(up.withColumnRenamed("child", "v"), "v", "left").select("key", F.coalesce("parent", "v").alias("root")))
        least = rooted.groupBy("root").agg(F.min("key").alias("group_key"))
        return cut(looked_up(rooted, least, "root", total).select(F.col("key").alias("record_key"), "group_key"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_groups(table(spark, sf_dir, "cluster_edges"))


ORACLES = {
    "p5_found": """
        WITH RECURSIVE e AS (
            SELECT record_a AS u, record_b AS w FROM cluster_edges WHERE record_a <> '' AND record_b <> ''
            UNION SELECT record_b, record_a FROM cluster_edges WHERE record_a <> '' AND record_b <> ''),
        reach(v, g) AS (SELECT u, u FROM e UNION SELECT e.w, r.g FROM reach r JOIN e ON e.u = r.v WHERE r.g < e.w)
        SELECT v AS record_key, min(g) AS group_key FROM reach GROUP BY v""",
}
