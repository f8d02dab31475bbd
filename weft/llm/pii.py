"""Personal data replaced by keyed surrogates.

Each entity - an address, number, secret or name - is reduced to a canonical value, and its surrogate is drawn from a
stream keyed by the secret key, the type and that value.  So an entity has one surrogate in the whole corpus, whatever
its spelling (coreference), with the type, format, script and, for names, gender of the original.

Distinctness is checked over the corpus: all entities with their surrogates form a table; a surrogate that is itself an
entity of the corpus, or that several entities share, is drawn again for all but one of those, until none is left.  Only
entities that needed a second draw must be told to the tasks that rewrite the texts; that table is broadcast if it is
small, else joined to the documents in which they occur.

The key is secret: whoever has it can find the original of a surrogate by trying.  It comes from the caller or the session's
``KEY_SETTING``; without one nothing is replaced and an error raised.

Defined results: null text stays null, empty text empty; a text without entities stays as it is, byte for byte; repeated
rows get the same replacements; a very long text takes time in proportion to it; an empty table gives an empty result;
other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.common import computed, fresh, pin
from weft.llm.surrogates import find, render, surrogate

KEY_SETTING = "spark.weft.pii.key"
#: Redrawn entities that are broadcast; each is under 200 bytes.
FEW = 50_000


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct (kind, value) of all texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            met = {x[2:] for t in b["_text"] for x in find(t)}
            yield pd.DataFrame(sorted(met), columns=["kind", "value"])

    return docs.select(F.col(text).alias("_text")).mapInPandas(run, "kind string, value string").distinct()


def _drawn(values: DataFrame, key: bytes) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(drawn=[surrogate(key, k, v, a) for k, v, a in zip(b["kind"], b["value"], b["attempt"], strict=True)])

    return values.mapInPandas(run, "kind string, value string, attempt int, drawn string")


def redrawn(real: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt) of the entities whose first surrogate is not theirs to keep.  ``real`` is pinned."""
    settled = None
    pending = real.withColumn("attempt", F.lit(0))
    while True:
        now = pin(_drawn(pending, key))
        taken = real.select("kind", F.col("value").alias("drawn"))
        free = now.join(taken, ["kind", "drawn"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "drawn"), ["kind", "drawn"], "left_anti")
        winners = pin(free.groupBy("kind", "drawn").agg(F.min(F.struct("value", "attempt")).alias("x")).select("kind", "drawn", "x.value", "x.attempt"))
        settled = winners if settled is None else settled.unionByName(winners)
        pending = now.join(winners.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        pending = pin(pending)
        if pending.isEmpty():
            return settled.where("attempt > 0").select("kind", "value", "attempt")


def replace(docs: DataFrame, text: str = "text", key: bytes | None = None, details: bool = False) -> DataFrame:
    """``docs`` with surrogates in ``text``; with ``details`` also n_replaced and where and what they are."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, "").encode()
    if not key:
        raise ValueError(f"surrogates need a secret key: give one or set {KEY_SETTING}")
    again = pin(redrawn(pin(entities(docs, text)), key))
    few = again.limit(FEW + 1).count() <= FEW
    common = docs.sparkSession.sparkContext.broadcast({(r.kind, r.value): r.attempt for r in again.collect()} if few else {})
    own = fresh("_again", docs.columns)
    rows = docs if few else _with_own(docs, text, again, own)

    def run(given: list, more: list | None = None) -> list[list]:
        texts, counts, places = [], [], []
        for t, x in zip(given, more or [None] * len(given), strict=True):
            known = common.value if few else {(y["kind"], y["value"]): y["attempt"] for y in x or ()}
            found, out, at, where, length = find(t), [], 0, [], 0
            for start, end, kind, value in found:
                new = render(t[start:end], kind, surrogate(key, kind, value, known.get((kind, value), 0)))
                length += start - at
                where.append({"kind": kind, "start": length, "length": len(new)})
                out += [t[at:start], new]
                length, at = length + len(new), end
            texts.append("".join([*out, t[at:]]) if found else t)
            counts.append(len(found))
            places.append(where)
        return [texts, counts, places] if details else [texts]

    place = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())])
    new = [T.StructField(text, T.StringType())] + [T.StructField("n_replaced", T.IntegerType()), T.StructField("entities", T.ArrayType(place))] * details
    kinds = [pa.string(), pa.int32(), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))][: len(new)]
    return computed(rows, [text] if few else [text, own], new, kinds, run, () if few else (own,)).select(*docs.columns, *[n.name for n in new[1:]])


def _with_own(docs: DataFrame, text: str, again: DataFrame, own: str) -> DataFrame:
    """``docs`` with the column ``own``: the redrawn entities that occur in the row.  Rows meet by a 128-bit hash of the text."""
    a, b = fresh("_h1", docs.columns), fresh("_h2", docs.columns)
    h = [F.xxhash64(text).alias(a), F.xxhash64(F.lit(1), text).alias(b)]
    texts = docs.select(F.col(text).alias("t"), *h).toDF("t", "_h1", "_h2")
    occur = texts.mapInPandas(_occurrences, "_h1 long, _h2 long, kind string, value string").distinct()
    found = occur.join(again, ["kind", "value"]).groupBy("_h1", "_h2").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias(own))
    return docs.select("*", *h).join(found.toDF(a, b, own), [a, b], "left").drop(a, b)


def _occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(x, y, *e) for t, x, y in zip(b["t"], b["_h1"], b["_h2"], strict=True) for e in {f[2:] for f in find(t)}]
        yield pd.DataFrame(rows, columns=["_h1", "_h2", "kind", "value"])


def op9(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """doc_id, the text with surrogates, and what was replaced where."""
    out = replace(docs.select("doc_id", "text"), key=key, details=True)
    kinds = F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["kind"]))))
    return out.select("doc_id", "text", F.col("n_replaced").cast("long").alias("n_replaced"), kinds.alias("kinds"), "entities")
