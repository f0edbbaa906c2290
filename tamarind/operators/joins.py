"""Joins that need more than an equality: as-of, near, similar names, graph walks, best child rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarind.functions import text as x
from tamarind.operators.groups import measured
from tamarind.session import cut

METRES_PER_DEGREE = 111_194.9


def asof(left: DataFrame, right: DataFrame, on: str, left_day: str, right_day: str, value: str, within: int = 7) -> DataFrame:
    """Adds the last ``value`` of ``right`` with the same ``on``, at most ``within`` days before ``left_day``.

    Each right row is repeated for the days for which it may count, the latest wins per day, and the
    join is an equality; the reference side grows by a constant factor, the large side not at all.
    """
    days = right.where(f"{on} is not null and {right_day} is not null").withColumn("_day", F.explode(F.sequence(F.col(right_day), F.date_add(right_day, within))))
    best = days.groupBy(on, "_day").agg(F.max_by(F.struct(F.col(value).alias(value), F.col(right_day).alias(right_day)), F.struct(right_day, F.col(value))).alias("_r"))
    best = best.select(F.col(on), F.col("_day").alias(left_day), f"_r.{value}", f"_r.{right_day}")
    return left.join(best, [on, left_day], "left")


def near_pairs(points: DataFrame, key: str, lat: str, lng: str, metres: float, hot: int = 2_000) -> DataFrame:
    """Pairs ``(a, b, metres)``, a < b, within a great-circle distance, through the neighbour cells of a grid.

    Equal points are first reduced to one (``same_points``), since pairs are the result.  The points of
    a cell with more than ``hot`` of them are dealt to that many salts, and those around it are
    repeated for each, so that no task meets the whole crowd.
    """
    step = metres / METRES_PER_DEGREE * 1.001
    p = points.where(f"{key} is not null and {lat} is not null and {lng} is not null").select(F.col(key).alias("k"), F.col(lat).alias("y"), F.col(lng).alias("x")).distinct()
    # Columns of the grid widen with the latitude of their row, so both sides use the row's own width.
    row = F.floor(F.col("y") / step)
    width = lambda r: F.lit(step) / F.cos(F.radians(F.least(F.greatest(F.abs(r * step), F.abs((r + 1) * step)), F.lit(89.0))))
    home = p.withColumn("r", row).withColumn("c", F.floor(F.col("x") / width(F.col("r"))))
    around = p.withColumn("r", F.explode(F.array(row - 1, row, row + 1))).withColumn("c0", F.floor(F.col("x") / width(F.col("r")))).withColumn("c", F.explode(F.array(F.col("c0") - 1, F.col("c0"), F.col("c0") + 1)))
    # At most one crowded cell for each ``hot`` points, so their list is small against the points.
    crowded = F.broadcast(home.groupBy("r", "c").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("r", "c", F.ceil(F.col("n") / hot).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    a = home.join(crowded, ["r", "c"], "left").select("r", "c", F.pmod(F.xxhash64("k"), salts).cast("int").alias("s"), F.col("k").alias("a"), F.col("y").alias("ya"), F.col("x").alias("xa"))
    b = around.join(crowded, ["r", "c"], "left").select("r", "c", F.explode(F.sequence(F.lit(0), salts - 1)).alias("s"), F.col("k").alias("b"), F.col("y").alias("yb"), F.col("x").alias("xb"))
    h = F.pow(F.sin(F.radians(F.col("yb") - F.col("ya")) / 2), 2) + F.cos(F.radians("ya")) * F.cos(F.radians("yb")) * F.pow(F.sin(F.radians(F.col("xb") - F.col("xa")) / 2), 2)
    pairs = a.join(b, ["r", "c", "s"]).where("a < b").withColumn("metres", 2 * 6_371_000.0 * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))
    return pairs.where(F.col("metres") <= metres).select("a", "b", "metres").distinct()


def same_points(rows: DataFrame, key: str, lat: str, lng: str) -> DataFrame:
    """``(key, point, copies, lat, lng)``: each key of a located row with the least key of its very point and the number of keys there."""
    located = rows.where(f"{key} is not null and {lat} is not null and {lng} is not null").select(key, lat, lng).distinct()
    per = located.groupBy(lat, lng).agg(F.min(key).alias("point"), F.count("*").alias("copies"))
    return located.join(per, [lat, lng]).select(key, "point", "copies", lat, lng)


def similar_names(left: DataFrame, right: DataFrame, key: str, name: str, least: float = 0.6) -> DataFrame:
    """``(a, b, score)`` of names whose letter pairs have a Dice score of at least ``least``.

    Names are joined on shared letter pairs; only the rarest pairs that a match cannot do without are
    used, so common pairs never meet: of ``n`` pairs, ``n - ceil(least * n / (2 - least)) + 1`` rarest.
    """
    def side(df, alias):
        return df.where(f"{key} is not null and {name} is not null").select(F.col(key).alias(alias), x.grams(F.lower(F.regexp_replace(name, r"\s+", "")), 2).alias(f"g_{alias}")).where(F.size(f"g_{alias}") > 0)

    a, b = side(left, "a"), side(right, "b")
    counts = a.select(F.explode("g_a").alias("g")).unionByName(b.select(F.explode("g_b").alias("g"))).groupBy("g").agg(F.count("*").alias("n"))

    def prefix(df, alias):
        n = F.size(f"g_{alias}")
        keep = n - F.ceil(F.lit(least) * n / (2 - least) - 1e-9) + 1  # 0.6 * 7 / 1.4 in doubles is above 3
        exploded = df.select(alias, n.alias("size"), keep.alias("keep"), F.explode(f"g_{alias}").alias("g")).join(counts, "g")
        w = Window.partitionBy(alias).orderBy("n", "g")
        return exploded.withColumn("i", F.row_number().over(w)).where("i <= keep").select(alias, "g")

    met = prefix(a, "a").join(prefix(b, "b"), "g").select("a", "b").distinct()
    scored = met.join(a, "a").join(b, "b").withColumn("score", x.dice(F.col("g_a"), F.col("g_b")))
    return scored.where(F.col("score") >= least).select("a", "b", F.round("score", 6).alias("score"))


def best_children(children: DataFrame, parent: str, field: str, fields: list[str], value: str, rank: list[str]) -> DataFrame:
    """One column per field with the best child's value, by the greatest ``rank``; one scan of the children."""
    return children.groupBy(parent).agg(*(F.max_by(F.when(F.col(field) == f, F.col(value)), F.when(F.col(field) == f, F.struct(*(F.col(c) for c in rank)))).alias(f.lower()) for f in fields))


def walk(edges: DataFrame, starts: DataFrame, steps: int) -> DataFrame:
    """``(start, node, distance)`` of all nodes reached over directed edges ``(src, dst)`` in at most ``steps`` steps."""
    edges, frontiers = cut(edges.select("src", "dst")), [cut(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("distance")).distinct())]
    for k in range(1, steps + 1):
        step = frontiers[-1].join(edges.withColumnRenamed("src", "node"), "node").select("start", F.col("dst").alias("node"), F.lit(k).alias("distance")).distinct()
        # Each frontier is written once; those before are read again, not written again.
        before = reduce(DataFrame.unionByName, frontiers).select("start", "node")
        frontier, figures = measured(step.join(before, ["start", "node"], "left_anti"))
        if not figures["rows"]:
            break
        frontiers.append(frontier)
    return reduce(DataFrame.unionByName, frontiers)
