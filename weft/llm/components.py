"""Connected components of a distributed link table by alternating stars.

A hub with very many neighbours is no hot key: joins on a node with more than ``HUB`` links are dealt over ``SALTS`` tasks by
the neighbour.  Hubs are few, at most a row for each ``HUB`` links, and are what is broadcast.  No links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import pin

#: Tasks that the rows of one key are dealt over.
SALTS = 16
#: Links of a node that one task joins.
HUB = 1_024


def salted(rows: DataFrame, one: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined with ``one``, a row for each ``key``, which is repeated SALTS times to meet ``rows`` dealt by ``by``.

    Merged, never broadcast: the repeated rows compress well, so that they look smaller than they are in memory.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS))).hint("merge")
    return dealt.join(one.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [key, "_salt"]).drop("_salt")


def _told(links: DataFrame, least: DataFrame) -> DataFrame:
    """``links`` (a, b) with ``m`` from ``least`` (a, m, n), where ``n`` is how many links a node has; only hubs are salted."""
    hubs = least.where((F.col("n") > HUB) & F.col("m").isNotNull()).select("a", F.lit(SALTS).alias("_of"))  # with m, so that the exchange is reused
    dealt = links.join(F.broadcast(hubs), "a", "left").withColumn("_salt", F.pmod(F.xxhash64("b"), F.coalesce("_of", F.lit(1)))).drop("_of")
    last = F.when(F.col("n") > HUB, SALTS - 1).otherwise(0).cast("long")
    return dealt.hint("merge").join(least.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), last))), ["a", "_salt"]).drop("_salt", "n")


def _large(e: DataFrame) -> DataFrame:
    """Each node hands its smallest neighbour (or itself) to its larger neighbours."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _told(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    least = e.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _told(e, least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.where("n > 0").select("a", F.col("m").alias("b")))  # with n, so that the exchange is reused


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node that can be reached.

    Rounds of large and small stars until the link table stays as it is, which then holds a star for each component.
    The rounds grow with the logarithm of a component's size.
    """
    e = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    seen = None
    while True:
        e = pin(e)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = now
        e = _small(_large(e).where("a <> b").distinct()).distinct()
