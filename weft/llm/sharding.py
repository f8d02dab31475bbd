"""Shards of near-equal bytes by histogram sort.

Rows are ordered by a key: the hash of the text, then a hash of the row and its number.  Equal texts are neighbours, and
no two rows have equal keys.  The splitters are found without sorting: each round counts, exactly and over all rows, the
bytes and rows in every cell of a grid of candidate keys, and the next round refines the cells in which a splitter must
lie by 2**``STEP`` cells each.  A splitter is settled when a cell's edge is within ``tolerance`` x the shard's size of its
place.  Then the rows are exchanged once, by range, and numbered.

A group of equal texts stays in one shard unless a splitter's place lies within it; then it is cut at the row hash, so
neither a text nor a row that makes up a third of all can fill one shard.  Ranges are finer than shards, as many as
``RANGE_BYTES`` asks for, so no task sorts a shard alone; the edges between a shard's ranges may be off by half a range.

Defined results: null text has no bytes, size 1 and the crc32 of nothing; rows that are alike in all columns are numbered
and may be cut apart; an empty table gives an empty result; extra columns are ignored by :func:`assign`.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import pin, pin_table, row_hash

#: Bits of the key that each round adds; the two halves of the key have HALF bits each.
STEP, HALF = 10, 60
#: Ranges: as many as RANGE_BYTES asks for, RANGES at most and PARTS a shard at least.  All edges are held by the driver.
RANGE_BYTES, RANGES, PARTS = 64 << 20, 1 << 16, 4
#: Bytes of a row without its text.
NARROW = 64


def _levels(ranges: int) -> list[int]:
    """Bits of the key in each round.  The first grid is fine enough for the edges between ranges, 2**18 cells at most."""
    first = max(STEP, (2 * ranges).bit_length())
    return [*range(first, HALF, STEP), *range(HALF, 2 * HALF + 1, STEP)]


def _key(bits: int) -> list[Column]:
    """The key's first ``bits`` bits as two numbers."""
    first, second = min(bits, HALF), max(0, bits - HALF)
    return [F.shiftright("a", HALF - first), F.shiftright("b", HALF - second)]


def _edge(bits: int, cell: tuple[int, int]) -> tuple[int, int]:
    """The smallest key of a cell."""
    first, second = min(bits, HALF), max(0, bits - HALF)
    return cell[0] << (HALF - first), cell[1] << (HALF - second)


def _after(bits: int, cell: tuple[int, int]) -> tuple[int, int]:
    """The smallest key above a cell."""
    return _edge(bits, (cell[0], cell[1] + 1) if bits > HALF else (cell[0] + 1, 0))


def splitters(rows: DataFrame, places: list[tuple[float, float]], levels: list[int]) -> list[tuple[tuple[int, int], int]]:
    """For each place, (bytes below it, how far off it may be), a key and the number of rows below that key.

    ``rows`` (a, b, size) is counted once a round.  The driver gets the first grid, then 2**STEP counts for each cell that
    holds a splitter that is left.
    """
    found: dict[int, tuple[tuple[int, int], int]] = {}
    active = {(0, 0): (0, 0, list(range(len(places))))}  # cell: bytes and rows below it, the splitters in it
    for number, bits in enumerate(levels):
        if not active:
            break
        parent, child = _key(levels[number - 1] if number else 0), _key(bits)
        cut = rows.select(parent[0].alias("pa"), parent[1].alias("pb"), child[0].alias("ca"), child[1].alias("cb"), "size")
        if number:
            cells = rows.sparkSession.createDataFrame(list(active), "pa long, pb long")
            cut = cut.join(F.broadcast(cells), ["pa", "pb"])  # at most one row for each splitter
        counts = cut.groupBy("pa", "pb", "ca", "cb").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
        within: dict[tuple[int, int], list] = {}
        for r in sorted(counts, key=lambda r: (r.ca, r.cb)):
            within.setdefault((r.pa, r.pb), []).append(((r.ca, r.cb), r.bytes, r.n))
        onward: dict[tuple[int, int], tuple[int, int, list[int]]] = {}
        for cell, (low, n_low, wanted) in active.items():
            todo = sorted(wanted, key=lambda k: places[k][0], reverse=True)
            for cell_in, size, n in within.get(cell, []):
                high, n_high = low + size, n_low + n
                while todo and places[todo[-1]][0] < high:
                    k = todo.pop()
                    place, near = places[k]
                    if min(place - low, high - place) <= near or bits == levels[-1]:
                        at_low = place - low <= high - place
                        found[k] = (_edge(bits, cell_in), n_low) if at_low else (_after(bits, cell_in), n_high)
                    else:
                        onward.setdefault(cell_in, (low, n_low, []))[2].append(k)
                low, n_low = high, n_high
        active = onward
    return [found[k] for k in range(len(places))]


def assign(docs: DataFrame, keep: list[str], shards: int = 8, text: str = "text", tolerance: float = 0.002) -> DataFrame:
    """The columns ``keep`` of every row with its size in bytes, shard and slot.  Rows lie by (shard, slot)."""
    blank = F.coalesce(F.col(text), F.lit(""))
    hashed = lambda *cols: F.shiftrightunsigned(F.xxhash64(*cols), 64 - HALF)
    # the rows' numbers are fixed once they are written
    keyed = docs.select(*keep, (F.octet_length(blank) + 1).cast("long").alias("size"), hashed(blank).alias("a"), hashed(row_hash(docs), F.monotonically_increasing_id()).alias("b"))
    keyed = pin_table(keyed) if text in keep else pin(keyed)
    rows = keyed.select("a", "b", "size")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    moved = n * NARROW + total * (text in keep)
    parts = max(PARTS, min(RANGES // shards, -(-moved // (shards * RANGE_BYTES))))
    levels = _levels(shards * parts)
    part, shard = total / (shards * parts), total / shards
    places = [(part * k, part / 2 if k % parts else min(part / 2, shard * tolerance)) for k in range(1, shards * parts)]
    edges = splitters(rows, places, levels) if total else []
    starts = [((0, 0), 0), *edges]  # in order, as none is off by more than half a range
    table = [(k, e[0], e[1], k // parts, m - starts[k // parts * parts][1]) for k, (e, m) in enumerate(starts)]
    # the ranges that begin in each cell of the first round's grid, and the one that holds before them
    begins, grid = [t[1] for t in table], []
    for cell in range(1 << levels[0]):
        i, j = (bisect_left(begins, c << (HALF - levels[0])) for c in (cell, cell + 1))
        grid.append((cell, i - 1, [(t[1], t[2]) for t in table[i:j]]))
    spark = docs.sparkSession
    g = spark.createDataFrame(grid, "cell long, base int, inside array<struct<a:long,b:long>>")
    own = F.filter("inside", lambda e: (e["a"] < F.col("a")) | ((e["a"] == F.col("a")) & (e["b"] <= F.col("b"))))
    ranged = keyed.withColumn("cell", F.shiftright("a", HALF - levels[0])).join(F.broadcast(g), "cell").withColumn("range", F.col("base") + F.size(own))
    t = spark.createDataFrame([(x[0], x[3], x[4]) for x in table], "range int, shard int, first long")
    order = Window.partitionBy("range").orderBy("a", "b")
    numbered = ranged.withColumn("nth", F.row_number().over(order)).join(F.broadcast(t), "range")
    return numbered.select(*keep, "size", "shard", (F.col("first") + F.col("nth") - 1).alias("slot"))


def write(docs: DataFrame, path: str, shards: int = 8, **how) -> None:
    """Parquet folders ``shard=0`` ... under ``path``, each row with its slot."""
    assign(docs, docs.columns, shards, **how).write.partitionBy("shard").parquet(path)


def op8(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    rows = docs.select("doc_id", "text", F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"))
    out = assign(rows, ["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
