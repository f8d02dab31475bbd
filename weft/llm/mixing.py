"""Mixing sources to target weights by pivotal dependent rounding.  DataFrame functions only.

Each source gets a target number of words.  A document's expected number of copies is its source's target over the
source's size; the whole part is certain, and the fractional part is rounded by the pivotal method.  A document's
*mass* is fraction x size, in words.  Two documents of a source meet: a coin, weighted so that expectations stay, moves
mass from one to the other until one is empty or full, hence decided.  The other carries the rest on.  No step changes
the mass of the source, so the words taken differ from the target only by the coin of its last document.

That document would be one of the longest, as of two that meet the shorter one is decided.  So the documents longer than
1/``FINE`` of their source, FINE of them at most, come first, from long to short: each meets all shorter ones at once, which
give or take mass in equal shares.  The shorter ones all have one fraction, which moves a little, and the coin keeps all
expectations as before.  What the source is off by is then the coin of a document of 1/FINE of its size at most, unless the
shorter ones can't make up for a long one.

The pairs form a reduction tree.  A leaf holds about ``FAN_IN`` documents of a source, dealt by a hash of the row, is
folded by one ``aggregate`` call and sends one undecided document up; the next level folds ``FAN_IN`` of those.  A source
with a third of all rows has a third of the leaves.  All coins are hashes of row, its number among equal rows, and seed:
reruns agree, also those of lost tasks.

Defined results: null text has size 0; a document of size 0 is never decided by a coin and is taken 0 words; null
sources form one source, ordered last; identical rows are numbered and decided each; an empty table gives an empty result;
extra columns are kept by :func:`mix` and ignored by :func:`plan`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import boxed, keys_of, pin, row_hash, small, uniform, word_count

FAN_IN = 64
#: Documents longer than this part of their source are settled first.
FINE = 500
#: Equal rows that are numbered in one place; more are dealt over the tasks.
CHUNK = 4_096


def source_targets(sizes: DataFrame, epochs: float, weights: Sequence[float], cap: float) -> DataFrame:
    """(source, source_size, target) of (source, size): ``epochs`` x all words, shared by weight, at most ``cap`` x size.

    Sharing what capped sources leave over again and again ends where target = min(cap x size, level x weight).  With the
    sources ordered by cap x size / weight, that level is found at the first source which it leaves uncapped.  The window
    runs over one row per source, never over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    by_room = Window.orderBy("room", "rank")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("rank", F.row_number().over(order))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1))
    per = per.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("room", F.col("most") / F.col("weight"))
    before = F.coalesce(F.sum("most").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    wanted = F.sum("source_size").over(everything) * F.lit(float(epochs))
    per = per.withColumn("level", (wanted - before) / onward)
    level = F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "rank", "level"))).over(everything)["level"]
    return per.withColumn("all", level).select("source", "source_size", F.when(F.col("all").isNull(), F.col("most")).otherwise(F.least("most", F.col("all") * F.col("weight"))).alias("target"))


def _moved(it: Column, m: Column) -> Column:
    return F.struct(it["h"].alias("h"), it["row"].alias("row"), it["size"].alias("size"), m.alias("m"))


def _verdict(it: Column, up: Column) -> Column:
    return F.struct(it["row"].alias("row"), it["size"].alias("size"), up.alias("up"))


def _meet(seed: int, level: int):
    """One meeting: the carry ``c`` and the next item ``x``.  Exactly one of them is decided."""

    def merge(acc: Column, x: Column) -> Column:
        c = acc["carry"]
        c_lacks, x_lacks = c["size"] - c["m"], x["size"] - x["m"]
        gain, loss = F.least(c_lacks, x["m"]), F.least(c["m"], x_lacks)
        to_c = uniform(F.lit(seed), F.lit(level), c["h"], x["h"]) * (gain + loss) < loss
        c_ends = F.when(to_c, c_lacks <= x["m"]).otherwise(c["m"] <= x_lacks)
        left = F.when(to_c & c_ends, x["m"] - c_lacks).when(to_c, c["m"] + x["m"]).when(c_ends, x["m"] + c["m"]).otherwise(c["m"] - x_lacks)
        stays = F.when(c_ends, _moved(x, left)).otherwise(_moved(c, left))
        verdict = F.when(c_ends, _verdict(c, to_c == c_ends)).otherwise(_verdict(x, to_c == c_ends))
        return F.struct(stays.alias("carry"), F.concat(acc["done"], F.array(verdict)).alias("done"))

    return merge


def _times(rows: DataFrame, n: str, ordinal: str, many: bool) -> DataFrame:
    """Every row ``n`` times, numbered from 0; where there are ``many``, chunks of them are dealt over the tasks."""
    upto = lambda last: F.sequence(F.lit(0).cast("long"), last)
    if not many:
        return rows.withColumn(ordinal, F.explode(upto(F.col(n) - 1)))
    few = rows.where(F.col(n) <= CHUNK).withColumn(ordinal, F.explode(upto(F.col(n) - 1)))
    first = rows.where(F.col(n) > CHUNK).withColumn(ordinal, F.explode(upto(F.expr(f"({n} - 1) div {CHUNK}")))).repartition(ordinal)
    return few.unionByName(first.withColumn(ordinal, F.explode(F.transform(upto(F.least(F.lit(CHUNK), F.col(n) - F.col(ordinal) * CHUNK) - 1), lambda i: i + F.col(ordinal) * CHUNK))))


def _fold(live: DataFrame, by: list[str], seed: int, level: int) -> DataFrame:
    """The items (h, row, size, m) of each group folded: ``f.carry`` is undecided, ``f.done`` are verdicts.  Pinned."""
    grouped = live.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("h", "row", "size", "m"))).alias("items"))
    nothing = F.slice(F.array(_verdict(F.expr("items[0]"), F.lit(False))), 1, 0)
    start = F.struct(F.expr("items[0]").alias("carry"), nothing.alias("done"))
    return pin(grouped.select(*by, F.aggregate(F.slice("items", 2, F.size("items")), start, _meet(seed, level)).alias("f")))


def _settled(long_: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """(t_source, fraction, done): the fraction that each source's long documents leave to the others, and their verdicts."""
    items = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("least"), "h", "row", "size")))  # FINE at most
    t = small(targets).select(F.col("source").alias("t_source"), "source_size", "target")
    met = long_.groupBy("source").agg(items.alias("items")).join(t, F.col("source").eqNullSafe(F.col("t_source")))
    coin = lambda x, k: uniform(F.lit(seed), F.lit(k), x["h"])

    def merge(acc: Column, x: Column) -> Column:
        others = F.greatest(acc["others"] - x["size"], F.lit(0.0))
        m, mass = x["size"] * acc["f"], others * acc["f"]
        lacks, room = x["size"] - m, others - mass
        gain, loss = F.least(lacks, mass), F.least(m, room)
        wins = coin(x, -2) * (gain + loss) < loss
        rest = m + F.when(wins, gain).otherwise(-loss)
        up = F.when(wins & (lacks <= mass), True).when(~wins & (m <= room), False).otherwise(coin(x, -3) * x["size"] < rest)
        f = F.when(others > 0, acc["f"] + F.when(wins, -gain).otherwise(loss) / others).otherwise(acc["f"])
        return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), f)).alias("f"), others.alias("others"), F.concat(acc["done"], F.array(_verdict(x, up))).alias("done"))

    per = F.col("target") / F.col("source_size")
    nothing = F.slice(F.array(_verdict(F.expr("items[0]"), F.lit(False))), 1, 0)
    start = F.struct((per - F.floor(per)).alias("f"), F.col("source_size").cast("double").alias("others"), nothing.alias("done"))
    return pin(met.select("t_source", F.aggregate("items", start, merge).alias("s")).select("t_source", F.col("s.f").alias("fraction"), "s.done"))


def plan(items: DataFrame, epochs: float = 1.5, weights: Sequence[float] = (5, 2, 1), cap: float = 2.0, seed: int = 17) -> DataFrame:
    """Of ``items`` (doc_id, rk, source, size, n) each of the n equal rows, with source_size, target and copies."""
    items = pin(items)
    total, most = items.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    targets = pin(source_targets(items.select("source", (F.col("size") * F.col("n")).alias("size")), epochs, weights, cap))
    t = small(targets).withColumnRenamed("source", "t_source")
    per = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = _times(items, "n", "nth", most > CHUNK).drop("n").join(t, F.col("source").eqNullSafe(F.col("t_source")), "inner").drop("t_source")
    rows = rows.withColumn("sure", F.floor(per)).withColumn("part", per - F.floor(per))
    keep = [*[c for c in items.columns if c != "n"], "source_size", "target", "sure"]
    known = rows.where((F.col("part") == 0) | (F.col("size") == 0)).select(*keep, F.lit(False).alias("up"))
    live = rows.where((F.col("part") > 0) & (F.col("size") > 0)).select(
        "source",
        F.xxhash64(F.lit(seed), "doc_id", "rk", "nth").alias("h"),
        F.struct(*keep).alias("row"),
        F.col("size").cast("double").alias("size"),
        (F.col("size") * F.col("part")).alias("m"),
        (F.col("size") * FINE > F.col("source_size")).alias("long"),
    )
    settled = _settled(live.where("long"), targets, seed)
    left = small(settled.select("t_source", "fraction"))
    live = live.where("not long").drop("long").join(left, F.col("source").eqNullSafe(F.col("t_source")), "left")
    live = live.withColumn("m", F.coalesce(F.col("size") * F.col("fraction"), "m")).drop("t_source", "fraction")
    blocks, level = max(1, -(-total // FAN_IN)), 0
    live = live.withColumn("block", F.pmod("h", F.lit(blocks)))
    done = [known, settled.select(F.inline("done")).select("row.*", "up")]
    while True:
        folded = _fold(live, ["source", "block"], seed, level)
        done.append(folded.select(F.inline("f.done")).select("row.*", "up"))
        if blocks == 1:
            break
        blocks, level = -(-blocks // FAN_IN), level + 1
        live = folded.select("source", "f.carry.*", F.expr(f"block div {FAN_IN}").alias("block"))
    last = folded.select("source", "f.carry.*").withColumn("up", uniform(F.lit(seed), F.lit(-1), F.col("h")) * F.col("size") < F.col("m"))
    out = last.select("row.*", "up")
    for d in done:
        out = out.unionByName(d)
    return out.withColumn("copies", F.col("sure") + F.col("up").cast("long")).drop("sure", "up")


def _items(docs: DataFrame, text: str, source: str) -> DataFrame:
    items = docs.select("doc_id", row_hash(docs).alias("rk"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    return items.groupBy("doc_id", "rk", "source", "size").agg(F.count(F.lit(1)).alias("n"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", **how) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it; columns as before."""
    chosen = keys_of(plan(_items(docs, text, source), **how).where("copies > 0"), "doc_id", "rk", "copies")
    chosen = pin(chosen.groupBy("ik", "rk").agg(F.sum("copies").alias("copies")))
    most = chosen.agg(F.coalesce(F.max("copies"), F.lit(0))).first()[0]
    out = boxed(docs).dropDuplicates(["ik", "rk"]).join(chosen, ["ik", "rk"])
    return _times(out.select("row", "copies"), "copies", "nth", most > CHUNK).select("row.*")


def op7(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target of its source, and the words taken of it."""
    chosen = plan(_items(docs, "text", "source"))
    return chosen.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
