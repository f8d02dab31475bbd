"""Near-duplicates by SimHash and multi-index hashing.

A document's fingerprint has 64 bits, each the majority of that bit over the XXH64 values of its word shingles.  Equal
fingerprints are folded first, so a group of copies is one fingerprint from then on.  Two fingerprints are linked if at
most ``RADIUS`` = 4 bits differ.  The bits are cut into segments of 21, 21 and 22.  If the first two segments each differ
in two bits or more and the last in one or more, that makes 5: so linked fingerprints differ by at most one bit in one of
the first two segments, or agree in the last.  Hence each fingerprint enters one table per segment under its own value,
and for the first two also probes the Hamming ball of radius 1 - only the flips to a larger value, as the other side makes
the same flip back.  Everything that meets under a value is verified over all 64 bits.  From ``WIDE`` fingerprints on,
tables of 21 bits would be crowded, and two segments of 32 bits with radii 2 and 1 take their place: as 3 + 2 makes 5,
they find the same links with more probes of far fewer entries.

A value's meetings are searched without listing all pairs: small ones by comparing rows at growing distance, larger ones
by spreading from one fingerprint to all unvisited ones, which yields a spanning forest of the links.  Only links that
join something new within a task leave it; components need no more.  A value with more than ``BLOCK`` entries is dealt out
in pairs of blocks over many tasks.

Defined results: no words (null, empty, blanks) give fingerprint 0, linked like any other; fewer words than a shingle make
one shingle; repeated rows fall into one component; a null doc_id never names a component that has another id; an empty
table gives an empty result; extra columns are kept by :func:`keep_one` and ignored by :func:`groups`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.common import boxed, computed, keys_of, pin, row_hash, small
from weft.llm.components import components, salted

RADIUS = 4
#: Shift, bits and radius of each segment: for few and for many fingerprints, and where the latter begin.
SEGMENTS, WIDE_SEGMENTS = ((43, 21, 1), (22, 21, 1), (0, 22, 0)), ((32, 32, 2), (0, 32, 1))
WIDE = 30_000_000
#: Entries under one value that one task searches.
BLOCK = 16_384


def fingerprint(text: str | None, shingle: int) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    most = (bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(most, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = 4) -> DataFrame:
    """The columns ``keep`` of every row with its fingerprint ``fp``."""
    def run(texts: list) -> list[list[int]]:
        known: dict[str | None, int] = {}  # copies within a batch
        return [[known[t] if t in known else known.setdefault(t, fingerprint(t, shingle)) for t in texts]]

    rows = docs.select(*keep, F.col(text).alias("_text"))
    return computed(rows, ["_text"], [T.StructField("fp", T.LongType())], [pa.int64()], run, ("_text",))


def _masks(bits: int, radius: int) -> list[tuple[int, int]]:
    """(flips, highest of them) within the ball, without the middle."""
    out, last = [], [(1 << b, 1 << b) for b in range(bits)]
    for r in range(radius):
        if r:
            last = [(m | 1 << b, 1 << b) for m, top in last for b in range(top.bit_length(), bits)]
        out += last
    return out


def _keys(fp: Column, segments: tuple) -> list[Column]:
    """The own value in each segment, with the segment's number in front."""
    return [F.shiftrightunsigned(fp, shift).bitwiseAND((1 << bits) - 1) + (number << 32) for number, (shift, bits, _) in enumerate(segments)]


def _larger(key: Column, segments: tuple) -> Column:
    """The keys in the ball around a key that are larger than it: those whose highest flip sets a bit."""
    out = F.array().cast("array<bigint>")
    for number, (_, bits, radius) in enumerate(segments):
        if radius:
            masks = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(top).cast("long").alias("top")) for m, top in _masks(bits, radius)])
            near = F.transform(F.filter(masks, lambda x: key.bitwiseAND(x["top"]) == 0), lambda x: key.bitwiseXOR(x["m"]))
            out = F.when(F.shiftrightunsigned(key, 32) == number, near).otherwise(out)
    return out


class _Forest:
    """Joins what is linked; remembers only fingerprints that have a link."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p] if p in up else p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def stars(self) -> pa.RecordBatch:
        """(a, b): each fingerprint that has a link, beside the smallest it is joined with."""
        ends = [(x, r) for x in list(self.up) if (r := self.root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)], ["a", "b"])


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).astype(np.uint64)) <= RADIUS  # of signed numbers it counts the absolute value's bits


def _spread(fp: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links within one value."""
    fp = np.unique(fp)
    out: list[tuple[int, int]] = []
    left = fp
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            hit = _near(left, x)
            if hit.any():
                met, left = left[hit], left[~hit]
                out += [(int(x), int(y)) for y in met]
                front += list(met)
    return out


def _search(new: np.ndarray, own: np.ndarray, fps: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links among rows in order; ``new`` marks where another value begins, and every value is whole."""
    keys = np.cumsum(new)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(keys)))
    useful = (sizes > 1) & (np.add.reduceat(own.astype(np.int64), starts) > 0)
    for s, n in zip(starts[useful & (sizes > 48)], sizes[useful & (sizes > 48)], strict=True):
        yield from _spread(fps[s : s + n])
    little = np.repeat(useful & (sizes <= 48), sizes)
    keys, own, fps = keys[little], own[little], fps[little]
    for d in range(1, 48):
        if len(keys) <= d:
            break
        i = np.flatnonzero((keys[d:] == keys[:-d]) & (own[d:] | own[:-d]))
        if not len(i) and not (keys[d:] == keys[:-d]).any():
            break
        i = i[_near(fps[i], fps[i + d]) & (fps[i] != fps[i + d])]
        yield from zip(fps[i].tolist(), fps[i + d].tolist(), strict=True)


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` that connect all that is within RADIUS."""
    segments = SEGMENTS if distinct.count() < WIDE else WIDE_SEGMENTS
    own = distinct.select("fp", F.explode(F.array(*_keys(F.col("fp"), segments))).alias("value"))
    probes = _larger(F.col("value"), segments)
    entries = own.select("fp", F.lit(0).alias("pair"), F.posexplode(F.concat(F.array("value"), probes)).alias("at", "key")).withColumn("own", F.col("at") == 0).drop("at")
    # values with many entries: own ones, and those of the many that have a value around it; what is too few here to be
    # counted adds up to BLOCK at most
    ball = 1 + max(len(_masks(bits, radius)) for _, bits, radius in segments)
    many = own.groupBy(F.col("value")).count().where(F.col("count") > BLOCK // ball)
    hot = many.select("count", F.explode(F.concat(F.array("value"), _larger(F.col("value"), segments))).alias("key"))
    hot = pin(hot.groupBy("key").agg(F.sum("count").alias("n")).where(F.col("n") > BLOCK).select("key", F.expr(f"ceil(n / {BLOCK})").alias("blocks")))
    if not hot.isEmpty():
        entries = entries.join(small(hot), "key", "left")
        block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.least(block, j) * F.lit(1 << 31) + F.greatest(block, j) + 1)
        entries = entries.withColumn("pair", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs))).drop("blocks")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, rest = _Forest(), None

        def found(b: pd.DataFrame) -> pd.DataFrame:
            keys, pairs = b["key"].to_numpy(np.int64), b["pair"].to_numpy(np.int64)
            begins = np.ones(len(b), bool)
            begins[1:] = (keys[1:] != keys[:-1]) | (pairs[1:] != pairs[:-1])
            joined = [x for x in _search(begins, b["own"].to_numpy(bool), b["fp"].to_numpy(np.int64)) if forest.join(*x)]
            return pd.DataFrame(np.array(joined, np.int64).reshape(-1, 2), columns=["a", "b"])

        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if not len(b):
                continue
            last = (b["key"] == b["key"].iloc[-1]) & (b["pair"] == b["pair"].iloc[-1])
            rest = b[last]
            yield found(b[~last])
        if rest is not None:
            yield found(rest)

    return entries.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInPandas(run, "a long, b long")


def groups(fps: DataFrame, linked: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """``fps`` (doc_id, rk, fp; pinned) with ``first``: doc_id and rk of the first row of its component."""
    ident = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rk")
    distinct = pin(fps.groupBy("fp").agg(F.min(ident).alias("first")))
    roots = components(linked(distinct.select("fp"))).withColumnRenamed("node", "fp")
    rooted = pin(distinct.join(roots, "fp", "left"))
    alone = rooted.where("root is null").select("fp", "first")
    rooted = rooted.where("root is not null")
    # a component may hold very many fingerprints: its rows are dealt over SALTS tasks
    tops = rooted.groupBy("root").agg(F.min("first").alias("top"))
    named = salted(rooted.select("fp", "root"), tops, "root", "fp").select("fp", F.col("top").alias("first"))
    return fps.join(alone.unionByName(named), "fp")


def _fps(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    keyed = docs.select("doc_id", text, row_hash(docs).alias("rk"))
    return pin(fingerprints(keyed, ["doc_id", "rk"], text, shingle))


def keep_one(docs: DataFrame, text: str = "text", shingle: int = 4) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest doc_id; columns as before."""
    return one_of_each(docs, groups(_fps(docs, text, shingle)))


def one_of_each(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`groups` names as first."""
    top = keys_of(grouped.select("first.*"), "doc_id", "rk").distinct()
    return boxed(docs).join(top, ["ik", "rk"], "left_semi").dropDuplicates(["ik", "rk"]).select("row.*")


def op4(docs: DataFrame) -> DataFrame:
    out = groups(_fps(docs, "text", 4))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))
