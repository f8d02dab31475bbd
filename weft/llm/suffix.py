"""Removal of long repeated passages: every byte in a ``WINDOW``-byte string that starts at two places of the corpus.

Which window starts are repeated is a question about the sorted suffixes: a start is repeated if its suffix and a
neighbour's have WINDOW bytes in common.  The suffixes are never sorted all at once:

1. Equal windows hold the same ``GRAM``-byte string of smallest hash, their *anchor*, at the same offset.  A maximal run of
   starts with one anchor is a *unit* (about 65 starts), and its span is the bytes of its windows.  A unit is known by the
   64-bit hash of its anchor and a 128-bit hash of its span, of another kind.  Only these numbers are shuffled, duplicates
   within a task folded first.
2. Units with equal spans are repeated as a whole: so are the insides of copies and long passages, at a cost of some bytes
   for each unit.  A unit whose anchor is met nowhere else is not repeated.  What is left, units with a common anchor and
   different spans, are the edges of repeated passages.
3. For those the spans are fetched and, per anchor, the suffixes that begin at it are sorted by the hash-compared
   mergesort of :mod:`weft.llm.suffixsort`; neighbours give the common extension to the right, a binary search that to the
   left, and both together the repeated starts.  Matches are verified byte by byte.
4. An anchor with more than ``CROWD`` different spans, such as the end of a very common line, is split by the order of its
   suffixes: the distances from a start to the anchor are cut into ``PARTS`` ranges, and all windows of a range hold the
   bytes that reach from its largest distance to the smallest one's end.  This longer string takes the anchor's place, and
   steps 2 to 4 are done again with it.  After four rounds a range is one distance and its string the window itself, so the
   rounds end however many spans there are, and every group that is sorted has CROWD members at most.

No group meets in one task: rows with an anchor that has more than its share of a task's different spans are dealt by
their span as well, and a witness row tells the other rows of that anchor.

Defined results: null and empty texts have no bytes; texts shorter than WINDOW lose nothing; repeated rows repeat each
other; bytes, not characters, are removed, so :func:`clean` drops broken characters at the seams; an empty table gives an
empty result; extra columns are ignored by :func:`op10` and kept by :func:`clean`.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.common import by_filter, computed, fresh, pin_table
from weft.llm.suffixsort import Hashes, PrimeHashes, common, mixed, sort_buckets
from weft.llm.vocab import worker_store

WINDOW, GRAM = 200, 32
#: Different spans that are sorted together, and ranges into which the distances of a larger group are cut.
CROWD, PARTS = 64, 4
#: Bytes that are hashed at once, and units, or spans, after which a task folds duplicates.
BUFFER, FOLD, FOLD_SPANS = 1 << 19, 200_000, 20_000
#: An anchor with more than this share of a task's units, and LEAST_HOT of them, is dealt by its spans.
HOT_SHARE, LEAST_HOT = 1 / 2_000, 8
_U = np.uint64


def _powers() -> dict:
    return worker_store().setdefault("powers", {})


def units(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first start, starts, anchor's place, anchor's hash, span's hashes) of the units of a buffer of texts."""
    reach = WINDOW - GRAM + 1
    n = len(data) - WINDOW + 1
    gram = mixed(Hashes(data, _powers()).windows(GRAM))
    key = (gram & ~_U(0xFFFFFF)) | np.arange(len(gram), dtype=np.uint64)  # ties go to the leftmost
    rows = np.concatenate((key, np.full(-len(key) % reach, ~_U(0)))).reshape(-1, reach)
    ahead, behind = np.minimum.accumulate(rows, axis=1).ravel(), np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[reach - 1 : reach - 1 + n])
    inside = np.zeros(len(data) + 1, np.int64)  # +1 where a text's starts begin, -1 where they end
    long_ = np.diff(bounds) >= WINDOW
    inside[bounds[:-1][long_]] += 1
    inside[bounds[1:][long_] - WINDOW + 1] -= 1
    fine = np.cumsum(inside)[:n] > 0
    new = np.concatenate(([True], (least[1:] != least[:-1]) | (fine[1:] != fine[:-1])))
    new[bounds[:-1][bounds[:-1] < n]] = True
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, n))
    start, count = start[fine[start]], count[fine[start]]
    at = (least[start] & _U(0xFFFFFF)).astype(np.int64)
    view, digest = memoryview(data), xxhash.xxh3_128_digest
    spans = b"".join([digest(view[i:j]) for i, j in zip(start.tolist(), (start + count + WINDOW - 1).tolist(), strict=True)])
    return start, count, at, gram[at], np.frombuffer(spans, np.uint64).reshape(-1, 2)


def _pieces(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], list[int]]]:
    """Buffers of whole texts, (bytes, bounds, rows, offsets in their texts); a long text comes in overlapping pieces."""
    parts, bounds, rows, bases = [], [0], [], []

    def out():
        return np.frombuffer(b"".join(parts), np.uint8), np.array(bounds, np.int64), rows, bases

    for row, text in enumerate(b.column("bytes").to_pylist()):
        for base in range(0, max(1, len(text or b"") - WINDOW + 1), BUFFER):
            piece = (text or b"")[base : base + BUFFER + WINDOW - 1]
            if len(piece) < WINDOW:
                continue
            if parts and bounds[-1] + len(piece) > 2 * BUFFER:
                yield out()
                parts, bounds, rows, bases = [], [0], [], []
            parts.append(piece), bounds.append(bounds[-1] + len(piece)), rows.append(row), bases.append(base)
    if parts:
        yield out()


# What a dealt row is: alone in its task, the one that goes on of several, one of the others (known to be repeated), and
# the first two again of an anchor that is dealt by its spans; a witness only says that its anchor is.
ALONE, MANY, DONE, HOT_ALONE, HOT_MANY, WITNESS = range(6)
IDENT = "rid long, rid2 long, s long, n int, o int"
DEALT = "p long, k long, ch long, ch2 long, role byte"
SPANNED = "k long, kind byte, crowd boolean, rid long, rid2 long, s long, n int, o int, span binary, lo int, hi int"


def _dealt(k: np.ndarray, ch: np.ndarray, known: np.ndarray, own: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    """A task's rows with the number ``p`` they are dealt by; of those with equal ``k`` and ``ch`` one goes on.

    ``known`` marks rows that are repeated elsewhere; the columns ``own`` begin with rid, rid2 and s.
    """
    order = np.lexsort((ch[:, 1], ch[:, 0], k))
    k, ch, known = k[order], ch[order], known[order]
    new_k = np.concatenate(([True], k[1:] != k[:-1]))
    first = new_k | np.concatenate(([True], (ch[1:] != ch[:-1]).any(axis=1)))
    starts, of_k = np.flatnonzero(first), np.flatnonzero(new_k)
    many = np.zeros(len(k), bool)
    many[starts] = (np.diff(np.append(starts, len(k))) > 1) | np.logical_or.reduceat(known, starts)
    crowded = np.add.reduceat(first.astype(np.int64), of_k) > max(LEAST_HOT, len(k) * HOT_SHARE)
    hot = np.repeat(crowded, np.diff(np.append(of_k, len(k))))
    own = [c.take(pa.array(order)) for c in own]
    rid, s = own[0].to_numpy().view(np.uint64), own[2].to_numpy().view(np.uint64)
    p = np.where(~first, mixed(rid + mixed(s)), np.where(hot, mixed(k ^ mixed(ch[:, 0])), k))
    role = np.where(~first, DONE, np.where(hot, HOT_ALONE, ALONE) + many).astype(np.int8)
    told = k[of_k[crowded]]  # sorted before all other rows of their anchors
    least = np.full(len(told), np.iinfo(np.int64).min)
    cols = [np.concatenate((p, told)).view(np.int64), np.concatenate((k, told)).view(np.int64), np.concatenate((ch[:, 0].view(np.int64), least)), np.concatenate((ch[:, 1].view(np.int64), least)), np.concatenate((role, np.full(len(told), WITNESS, np.int8)))]
    cols = [pa.array(c) for c in cols] + [pa.concat_arrays([c, pa.nulls(len(told), c.type)]) for c in own]
    return pa.RecordBatch.from_arrays(cols, ["p", "k", "ch", "ch2", "role", *names])


def _find_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of texts, dealt."""
    held: list[tuple[np.ndarray, ...]] = []

    def fold() -> pa.RecordBatch:
        rid, rid2, s, n, o, kh, ch = (np.concatenate(x) for x in zip(*held, strict=True))
        own = [pa.array(rid), pa.array(rid2), pa.array(s), pa.array(n.astype(np.int32)), pa.array(o.astype(np.int32))]
        return _dealt(kh, ch, np.zeros(len(kh), bool), own, ["rid", "rid2", "s", "n", "o"])

    size = 0
    for b in batches:
        rid, rid2 = b.column("rid").to_numpy(), b.column("rid2").to_numpy()
        for data, bounds, rows, bases in _pieces(b):
            start, count, at, kh, ch = units(data, bounds)
            text = np.searchsorted(bounds, start, "right") - 1
            row = np.array(rows, np.int64)[text]
            held.append((rid[row], rid2[row], start - bounds[text] + np.array(bases, np.int64)[text], count, at - start, kh, ch))
            size += len(start)
            if size > FOLD:
                yield fold()
                held, size = [], 0
    if size:
        yield fold()


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Crowded spans cut by ranges of the distance to the anchor, dealt by the string that all windows of a range hold."""
    names = ["rid", "rid2", "s", "n", "o", "span", "lo", "hi"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]

    def fold(rows: list[tuple]) -> pa.RecordBatch:
        k, ch, known, *own = zip(*rows, strict=True)
        ch = np.frombuffer(b"".join(ch), np.uint64).reshape(-1, 2)
        return _dealt(np.array(k, np.uint64), ch, np.array(known), [pa.array(c, t) for c, t in zip(own, kinds, strict=True)], names)

    held: list[tuple] = []
    for b in batches:
        for x in b.to_pylist():
            step = -(-(x["hi"] - x["lo"] + 1) // PARTS)
            for lo in range(x["lo"], x["hi"] + 1, step):
                hi = min(lo + step - 1, x["hi"])
                low, high = max(lo, x["o"] - x["n"] + 1), min(hi, x["o"])
                if low <= high:
                    o = x["o"]
                    held_by_all, span = x["span"][o - lo : o + WINDOW - hi], x["span"][o - high : o + WINDOW - low]
                    k = xxhash.xxh3_64_intdigest(struct.pack("<qii", x["k"], lo, hi) + held_by_all)
                    held.append((k, xxhash.xxh3_128_digest(struct.pack("<i", high) + span), x["kind"] == 1, x["rid"], x["rid2"], x["s"] + o - high, high - low + 1, high, span, lo, hi))
        if len(held) > FOLD_SPANS:
            yield fold(held)
            held = []
    if held:
        yield fold(held)


def _classify(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows sorted by (p, k, ch, ch2): kind 0, repeated as a whole; of each different span under an anchor with
    several, one more row of kind 1 (repeated) or 2 (alone).  Holds one row from batch to batch, however long a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        prev_k = prev_ch = opened = told = False  # of the held row: its neighbours before it, whether its span's first row had one, a witness

        def judged(t: pa.Table, last: bool) -> pa.RecordBatch:
            nonlocal prev_k, prev_ch, opened, told
            p, k, ch, ch2, role = (t.column(c).combine_chunks().to_numpy() for c in ("p", "k", "ch", "ch2", "role"))
            done, witness = role == DONE, role == WITNESS
            same_k = (k[1:] == k[:-1]) & (p[1:] == p[:-1]) & ~done[1:] & ~done[:-1]
            same_ch = same_k & (ch[1:] == ch[:-1]) & (ch2[1:] == ch2[:-1]) & ~witness[1:] & ~witness[:-1]
            before_k, before_ch = np.concatenate(([prev_k], same_k)), np.concatenate(([prev_ch], same_ch))
            after_k, after_ch = np.append(same_k, False), np.append(same_ch, False)
            begin = np.maximum.accumulate(np.where(before_ch, -1, np.arange(len(k))))
            mixed_before = np.where(begin >= 0, before_k[begin], opened)
            begin = np.maximum.accumulate(np.where(before_k, -1, np.arange(len(k))))
            hot = np.where(begin >= 0, witness[begin], told) | (role == HOT_ALONE) | (role == HOT_MANY)
            upto = len(k) if last else len(k) - 1
            repeated = done | (role == MANY) | (role == HOT_MANY) | before_ch | after_ch
            cover = np.flatnonzero((repeated & ~witness)[:upto])
            shown = np.flatnonzero((~done & ~witness & ~after_ch & (mixed_before | after_k | hot))[:upto])
            prev_k, prev_ch, opened, told = bool(before_k[-1]), bool(before_ch[-1]), bool(mixed_before[-1]), bool(np.where(begin >= 0, witness[begin], told)[-1])
            rows = np.concatenate((cover, shown))
            kind = np.concatenate((np.zeros(len(cover), np.int8), np.where(repeated[shown], 1, 2).astype(np.int8)))
            t = t.select(names).take(pa.array(rows)).combine_chunks()
            own = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns]
            return pa.RecordBatch.from_arrays([*own, pa.array(kind), pa.array(hot[rows])], [*names, "kind", "hot"])

        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                t = t if rest is None else pa.concat_tables([rest, t])
                yield judged(t, False)
                rest = t.slice(t.num_rows - 1)
        if rest is not None:
            yield judged(rest, True)

    return run


def _judged(dealt: DataFrame, more: str = "") -> DataFrame:
    """The dealt rows classified, with the columns of IDENT and ``more``, pinned."""
    schema = f"{IDENT}, k long{more}, kind byte, hot boolean"
    names = [x.split()[0] for x in f"{IDENT}, k long{more}".split(", ")]
    return pin_table(dealt.repartition("p").sortWithinPartitions("p", "k", "ch", "ch2").mapInArrow(_classify(names), schema))


def _by_crowd(judged: DataFrame) -> DataFrame:
    """The rows of kinds 1 and 2 whose anchor has one of kind 2, with ``crowd``: too many to be sorted together."""
    calm, hot = judged.where("kind > 0 and not hot"), judged.where("kind > 0 and hot")
    anchors = calm.groupBy("k").agg(F.count(F.lit(1)).alias("spans"), F.max("kind").alias("most")).where("most = 2")
    calm = calm.join(anchors, "k").withColumn("crowd", F.col("spans") > CROWD).drop("spans", "most", "hot")
    return calm.unionByName(hot.drop("hot").withColumn("crowd", F.lit(True)))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("k", pa.int64()), ("kind", pa.int8()), ("crowd", pa.bool_()), ("rid", pa.int64()), ("rid2", pa.int64()), ("s", pa.int64()), ("n", pa.int32()), ("o", pa.int32()), ("span", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32())]
    schema = pa.schema(kinds)
    seen: set[tuple[int, int]] = set()  # a repeated row is asked once
    for b in batches:
        rows = []
        for text, rid, rid2, asked in zip(*(b.column(c).to_pylist() for c in ("bytes", "rid", "rid2", "asked")), strict=True):
            if (rid, rid2) not in seen:
                seen.add((rid, rid2))
                rows += [(x["k"], x["kind"], x["crowd"], rid, rid2, x["s"], x["n"], x["o"], text[x["s"] : x["s"] + x["n"] + WINDOW - 1], 0, WINDOW - GRAM) for x in asked]
        cols = list(zip(*rows, strict=True)) or [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def extend(k: np.ndarray, kind: np.ndarray, n: np.ndarray, o: np.ndarray, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first start in the span, starts): the repeated starts of the rows of kind 2.  Rows are sorted by k.

    Anchors are at offset ``o`` of a span.  Starts of a span that match another one are those whose distance a to the
    anchor is at most the common extension to the left, and WINDOW - a at most that to the right.
    """
    data = np.frombuffer(b"".join(spans), np.uint8)
    length = np.array([len(s) for s in spans], np.int64)
    base = np.cumsum(length) - length
    n, o = n.astype(np.int64), o.astype(np.int64)
    place, room = base + o, length - o
    h = PrimeHashes(data, _powers())
    starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    sizes = np.diff(np.append(starts, len(k)))
    first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    order = sort_buckets(h, data, place, room, first, size)
    next_common = np.zeros(len(k), np.int64)  # of each in order with the next of its bucket
    i = np.flatnonzero(first[1:] == first[:-1])
    x, y = order[i], order[i + 1]
    next_common[i] = common(h, place[x], place[y], np.minimum(room[x], room[y]))
    out = []
    for side in (1, -1):
        at = np.flatnonzero(kind[order] == 2)
        shared = np.full(len(at), np.iinfo(np.int64).max)
        for d in range(1, int(sizes.max(initial=0))):
            to = at + side * d
            ok = (to >= first[at]) & (to < first[at] + size[at])
            at, to, shared = at[ok], to[ok], shared[ok]
            shared = np.minimum(shared, next_common[np.minimum(to, to - side)])
            x, y = order[at], order[to]
            ok = shared >= WINDOW - o[x]  # else not even the first start can match, nor with any further one
            at, x, y, shared = at[ok], x[ok], y[ok], shared[ok]
            if not len(at):
                break
            left = common(h, place[x], place[y], np.minimum(o[x], o[y]), -1)
            low, high = np.maximum(WINDOW - shared, o[x] - n[x] + 1), np.minimum(left, o[x])
            for r, v, a, z in zip(*(c[low <= high].tolist() for c in (x, y, low, high)), strict=True):
                p, q, right = int(place[r]), int(place[v]), WINDOW - a
                if data[p - z : p + right].tobytes() != data[q - z : q + right].tobytes():  # a collision: look at the bytes
                    left_ = next((i for i in range(z) if data[p - 1 - i] != data[q - 1 - i]), z)
                    limit = min(int(room[r]), int(room[v]))
                    right_ = next((i for i in range(limit) if data[p + i] != data[q + i]), limit)
                    a, z = max(WINDOW - right_, int(o[r] - n[r] + 1)), min(left_, z)
                if a <= z:
                    out.append((r, int(o[r]) - z, z - a + 1))
    found = np.array(out, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated starts (rid, rid2, s, n) from spans sorted by anchor; an anchor has CROWD spans at most."""
    names = ["rid", "rid2", "s", "n"]

    def found(t: pa.Table) -> pa.RecordBatch:
        k, kind, n, o, rid, rid2, s = (t.column(c).combine_chunks().to_numpy() for c in ("k", "kind", "n", "o", "rid", "rid2", "s"))
        row, low, many = extend(k, kind, n, o, t.column("span").to_pylist())
        return pa.RecordBatch.from_arrays([pa.array(rid[row]), pa.array(rid2[row]), pa.array(s[row] + low), pa.array(many.astype(np.int32))], names)

    rest: pa.Table | None = None
    for b in batches:
        for lo in range(0, b.num_rows, 2_048):
            t = pa.Table.from_batches([b.slice(lo, 2_048)])
            t = t if rest is None else pa.concat_tables([rest, t])
            k = t.column("k").combine_chunks().to_numpy()
            cut = int(np.searchsorted(k, k[-1], "left"))
            if cut:
                yield found(t.slice(0, cut))
            rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield found(rest)


def _sorted(spans: DataFrame) -> DataFrame:
    return spans.repartition("k").sortWithinPartitions("k").mapInArrow(_extended, "rid long, rid2 long, s long, n int")


def repeated(texts: DataFrame) -> DataFrame:
    """(rid, rid2, s, n): runs of repeated window starts in ``texts`` (rid, rid2, bytes); runs may overlap."""
    starts = ["rid", "rid2", "s", "n"]
    judged = _judged(texts.mapInArrow(_find_units, f"{DEALT}, {IDENT}"))
    asked = _by_crowd(judged).select("rid", "rid2", F.struct("k", "kind", "crowd", "s", "n", "o").alias("x"))
    asked = pin_table(asked.groupBy("rid", "rid2").agg(F.collect_set("x").alias("asked")))  # a document's own units
    may, _ = by_filter(texts, "rid", asked)
    spans = pin_table(may.join(asked, ["rid", "rid2"]).mapInArrow(_spans, SPANNED))
    found = judged.where("kind = 0").select(*starts).unionByName(_sorted(spans.where("not crowd")))
    crowded = spans.where("crowd")
    while not crowded.isEmpty():
        judged = _judged(crowded.mapInArrow(_finer, f"{DEALT}, {IDENT}, span binary, lo int, hi int"), ", span binary, lo int, hi int")
        spans = _by_crowd(judged)
        found = found.unionByName(judged.where("kind = 0").select(*starts)).unionByName(_sorted(spans.where("not crowd")))
        crowded = spans.where("crowd and lo < hi")
    return found


def runs(starts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal byte ranges that the windows cover."""
    out: list[list[int]] = []
    for s, n in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n + WINDOW - 1)
        else:
            out.append([s, s + n + WINDOW - 1])
    return [(a, b) for a, b in out]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for data, starts in zip(b.column("bytes").to_pylist(), b.column("starts").to_pylist(), strict=True):
            gone = runs([(x["s"], x["n"]) for x in starts or ()])
            kept = hashlib.sha256()
            at = 0
            for a, z in gone:
                kept.update(data[at:a])
                at = z
            kept.update(data[at:])
            rows.append((len(data), sum(z - a for a, z in gone), len(gone), kept.hexdigest()))
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _texts(docs: DataFrame, text: str, *more: str) -> DataFrame:
    """``rid`` and ``rid2``, 128 bits: rows that agree in doc_id and text share them, and repeat each other anyway."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(*more, F.xxhash64("doc_id", text).alias("rid"), F.xxhash64(F.lit(1), text, "doc_id").alias("rid2"), data.alias("bytes"))


def _starts(found: DataFrame) -> DataFrame:
    """(rid, rid2, starts); a repeated row's are folded in each task first, so a list is never longer than a document's own."""
    return found.groupBy("rid", "rid2").agg(F.collect_set(F.struct("s", "n")).alias("starts"))


def op10(docs: DataFrame) -> DataFrame:
    found = pin_table(_starts(repeated(_texts(docs, "text"))))
    may, free = by_filter(_texts(docs, "text", "doc_id"), "rid", found)
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = may.join(found, ["rid", "rid2"], "left").select("doc_id", "bytes", "starts").mapInArrow(_digest, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    zero = F.lit(0).cast("long")
    whole = free.select("doc_id", F.octet_length("bytes").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("bytes", 256).alias("kept_sha256"))
    return cut.unionByName(whole)


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``."""
    rid, rid2, starts = fresh("_rid", docs.columns), fresh("_rid2", docs.columns), fresh("_starts", docs.columns)
    found = pin_table(_starts(repeated(_texts(docs, text)))).toDF(rid, rid2, starts)
    rows = docs.withColumns({rid: F.xxhash64("doc_id", text), rid2: F.xxhash64(F.lit(1), text, "doc_id")}).join(found, [rid, rid2], "left").drop(rid, rid2)

    def run(texts: list, own: list) -> list[list]:
        out = []
        for t, x in zip(texts, own, strict=True):
            if t is not None and x is not None:
                data, at, parts = t.encode("utf-8"), 0, []
                for a, z in runs([(y["s"], y["n"]) for y in x]):
                    parts.append(data[at:a])
                    at = z
                t = b"".join([*parts, data[at:]]).decode("utf-8", "ignore")
            out.append(t)
        return [out]

    return computed(rows, [text, starts], [T.StructField(text, T.StringType())], [pa.string()], run, (starts,)).select(*docs.columns)
