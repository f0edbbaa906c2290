"""Texts that are alike by SimHash: copies collapse to one, near ones link through shared bit blocks."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarind.functions import text as x
from tamarind.operators.groups import connected
from tamarind.session import cut

#: Six blocks of the 64 bits: of two hashes that differ in at most three bits, three blocks are equal.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


def simhash_links(hashes: DataFrame, key: str = "h", within: int = 3) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of distinct nonzero 64-bit hashes that differ in at most ``within`` (up to 3) bits.

    Each hash is filed under its 20 choices of three blocks, some 32 bits each, so that a bucket of
    unlike hashes stays small also among billions; no pair is lost.
    """
    h = F.col(key)
    part = lambda o, n: F.shiftrightunsigned(h, o).bitwiseAND((1 << n) - 1)
    files = F.array(*(F.struct(F.lit(k).alias("t"), *(part(*BLOCKS[b]).alias(f"p{j}") for j, b in enumerate(chosen))) for k, chosen in enumerate(combinations(range(6), 3))))
    filed = hashes.where(f"{key} <> 0").select(key).distinct().select(key, F.explode(files).alias("f")).select(key, "f.*")
    a, b = filed.withColumnRenamed(key, "a"), filed.withColumnRenamed(key, "b")
    return a.join(b, ["t", "p0", "p1", "p2"]).where("a < b and bit_count(a ^ b) <= " + str(within)).select("a", "b").distinct()


def similar_texts(rows: DataFrame, key: str, text: str, within: int = 3) -> DataFrame:
    """``(key, class_key, copies, links)``: class by the least key, equal bare texts, links to other texts of the class.

    Texts are compared by the SimHash of their letters and digits.  Only distinct hashes are linked;
    copies join their hash.  Texts without letters and digits and null texts are classes of their own.
    """
    hashed = cut(rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), x.simhash(x.bare(F.coalesce(F.col(text), F.lit("")))).alias("h")).distinct())
    per = hashed.where("h <> 0").groupBy("h").agg(F.count("*").alias("copies"))
    links = cut(simhash_links(per))
    degree = links.select(F.explode(F.array("a", "b")).alias("h")).groupBy("h").agg(F.count("*").alias("links"))
    groups = connected(links.select(F.col("a").alias("u"), F.col("b").alias("w"))).withColumnRenamed("v", "h")
    of_hash = per.join(degree, "h", "left").join(groups, "h", "left").select("h", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("g", "h").alias("g"))
    placed = cut(hashed.join(of_hash, "h", "left"))
    least = placed.where("g is not null").groupBy("g").agg(F.min("key").alias("class_key"))
    return placed.join(least, "g", "left").select("key", F.coalesce("class_key", "key").alias("class_key"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
