"""Joins on conditions that are no equality.

A range condition - an attribute of one side compared with attributes of the other - becomes an equality of buckets.  The
buckets' bounds are quantiles of the range side's ends, found within the query itself.  The attribute lies in one bucket; a
range is repeated for each bucket it touches.  So the join is shuffled by bucket, the pairs that meet are checked by the
whole condition, and neither side is broadcast but by its size.  Conditions of another kind, such as LIKE, compare
all pairs of distinct keys and rows.

A range with one end meets half of all rows.  Aggregates over it that can be merged are carried on along the order of
values, and no pairs are made.  For others its rows are never broadcast, as the plan's estimate knows nothing of their repeats.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.model import Relation

#: Quantiles of each end; a power of two.
BOUNDS = 1_024
_SIDE = "\0([RT])(\\w+)\0"
_BETWEEN = re.compile(rf"({_SIDE})\s+between\s+({_SIDE})\s+and\s+({_SIDE})", re.I)
_COMPARED = re.compile(rf"\s*\(?\s*{_SIDE}\s*(<=|<|>=|>)\s*{_SIDE}\s*\)?\s*")
_EQUAL = re.compile(rf"\s*\(?\s*{_SIDE}\s*={{1,2}}\s*{_SIDE}\s*\)?\s*")


@dataclass(frozen=True)
class Range:
    """An attribute, of Related or This, between attributes of the other side; a missing bound is open."""

    related: bool
    attribute: str
    low: tuple[str, ...]
    high: tuple[str, ...]


def _conjuncts(r: Relation) -> list[str]:
    text = r.expression.render(lambda x: f"\0{'R' if x.related else 'T'}{x.attribute}\0")
    text = _BETWEEN.sub(lambda m: f"{m[1]} >= {m[4]} AND {m[1]} <= {m[7]}", text)
    parts = re.split(r"\s+and\s+", text, flags=re.I)
    # OR, NOT or brackets over several parts: the parts are no conditions of their own
    whole = all(p.count("(") == p.count(")") for p in parts) and not re.search(r"\b(or|not|case)\b", text, re.I)
    return parts if whole else [text]


def has_equality(r: Relation) -> bool:
    return any((m := _EQUAL.fullmatch(p)) and m[1] != m[3] for p in _conjuncts(r))


def range_of(r: Relation) -> Range | None:
    """The range that confines most: one with both ends, else one with an open end, else None."""
    low: dict[tuple[bool, str], list[str]] = {}
    high: dict[tuple[bool, str], list[str]] = {}
    for p in _conjuncts(r):
        m = _COMPARED.fullmatch(p)
        if m and m[1] != m[4]:
            a, b, less = (m[1] == "R", m[2]), (m[4] == "R", m[5]), m[3][0] == "<"
            (high if less else low).setdefault(a, []).append(b[1])
            (low if less else high).setdefault(b, []).append(a[1])
    found = [Range(*k, tuple(low.get(k, ())), tuple(high.get(k, ()))) for k in {**low, **high}]
    return min(found, key=lambda x: (not (x.low and x.high), x.related, x.attribute), default=None)


def _number(c: Column, kind: T.DataType) -> Column | None:
    """A column as a double that doesn't change its order, if there is one."""
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    return c.cast("double") if isinstance(kind, (T.NumericType, T.TimestampType)) else None


def _compared_as(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type as which SQL compares two types, where that is plain."""
    if a == b:
        return a
    if not (isinstance(a, T.NumericType) and isinstance(b, T.NumericType)):
        return None
    if T.DoubleType() in (a, b):
        return T.DoubleType()
    return T.LongType() if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType) else None


def cumulated(ours: DataFrame, others: DataFrame, r: Relation, mine: dict[str, str], theirs: dict[str, str], forward: bool, parts: dict[str, tuple[str, str]]) -> DataFrame | None:
    """For a relation that is one comparison, ``ours`` with ``parts``: aggregates over all matching rows of ``others``.

    ``parts`` gives an aggregate and the function that merges its values; over no rows they are NULL, and rows of ``ours``
    without a key are left out.  ``others`` are grouped by value; within a bucket of values a window merges what lies on the
    matching side of each of our rows, beginning with what is merged of the buckets before.  None for other relations.
    """
    m = _COMPARED.fullmatch(p[0]) if len(p := _conjuncts(r)) == 1 else None
    if m is None or m[1] == m[4]:
        return None
    theirs_first = (m[1] == "R") == forward
    their_name, our_name = (theirs[m[2]], mine[m[5]]) if theirs_first else (theirs[m[5]], mine[m[2]])
    upwards, or_equal = (m[3][0] == "<") == theirs_first, len(m[3]) == 2  # upwards: smaller values match
    kind = _compared_as(ours.schema[our_name].dataType, others.schema[their_name].dataType)
    number = None if kind is None else _number(F.col("__at"), kind)
    if number is None:
        return None
    quoted = lambda n: F.col("`" + n.replace("`", "``") + "`")
    values = others.where(quoted(their_name).isNotNull()).groupBy(quoted(their_name).cast(kind).alias("__at")).agg(*[F.expr(sql).alias(c) for c, (sql, _) in parts.items()])
    merged = lambda over: [over(F.call_function(f, F.col(c))).cast(values.schema[c].dataType).alias(c) for c, (_, f) in parts.items()]
    asked = ours.where(quoted(our_name).isNotNull()).withColumn("__at", quoted(our_name).cast(kind))
    rows = values.withColumn("__turn", F.lit(1)).unionByName(asked.withColumn("__turn", F.lit(2 if or_equal else 0)), allowMissingColumns=True)
    bounds = rows.agg(F.array_sort(F.array_distinct(_quantiles(number))).alias("bounds")).scalar()
    rows = _bucketed(rows.withColumn("__bounds", bounds), number, "__bucket").drop("__bounds")
    bucket, at = (F.col(c).asc_nulls_first() if upwards else F.col(c).desc_nulls_first() for c in ("__bucket", "__at"))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket, so at most BOUNDS
    carried = rows.groupBy("__bucket").agg(*merged(lambda x: x)).select("__bucket", *merged(lambda x: x.over(before)))
    until = Window.partitionBy("__bucket").orderBy(at, "__turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.unionByName(carried, allowMissingColumns=True).select(*ours.columns, "__turn", *merged(lambda x: x.over(until)))
    return found.where(F.col("__turn") != 1).drop("__turn")


def matches(ours: DataFrame, others: DataFrame, r: Relation, mine: dict[str, str], theirs: dict[str, str], forward: bool, condition: Column) -> DataFrame:
    """The inner join of ``ours`` and ``others``; ``mine`` and ``theirs`` give the columns of the attributes."""
    span = None if has_equality(r) else range_of(r)
    if span is None:
        return ours.join(others, condition)
    point_is_theirs = span.related == forward
    point, ranges = (others, ours) if point_is_theirs else (ours, others)
    at, ends = (theirs, mine) if point_is_theirs else (mine, theirs)
    quoted = lambda n: F.col("`" + n.replace("`", "``") + "`")
    column = lambda df, names, a: _number(quoted(names[a]), df.schema[names[a]].dataType)
    value = column(point, at, span.attribute)
    low, high = ([column(ranges, ends, a) for a in side] for side in (span.low, span.high))
    if value is None or any(x is None for x in (*low, *high)):
        return ours.join(others, condition)
    inner = [_quantiles(x) for x in (*low, *high)]
    outer = F.array(*[F.min(x) for x in low], *[F.max(x) for x in high])  # what lies beyond all ranges meets none
    made = F.array_sort(F.array_distinct(F.array_compact(F.concat(*inner, outer))))
    bounds = ranges.agg(made.alias("bounds")).scalar()
    point = _bucketed(point.where(value.isNotNull()).withColumn("__bounds", bounds), value, "__bucket").drop("__bounds")
    ranges = ranges.where(_all_known([*low, *high])).withColumn("__bounds", bounds)
    if low:
        ranges = _bucketed(ranges, F.greatest(*low) if len(low) > 1 else low[0], "__from")
    if high:
        ranges = _bucketed(ranges, F.least(*high) if len(high) > 1 else high[0], "__to")
    first, last = F.col("__from") if low else F.lit(0), F.col("__to") if high else F.size("__bounds")
    ranges = ranges.where(first <= last).withColumn("__touched", F.explode(F.sequence(first, last))).drop("__bounds", "__from", "__to")
    if not (low and high):  # touches half of all buckets, but would be broadcast if its file is small
        ranges = ranges.hint("merge")
    left, right = (ranges, point) if point_is_theirs else (point, ranges)
    return left.join(right, (F.col("__bucket") == F.col("__touched")) & condition).drop("__bucket", "__touched")


def _quantiles(value: Column) -> Column:
    at = F.array(*[F.lit(i / BOUNDS) for i in range(1, BOUNDS)])
    return F.coalesce(F.percentile_approx(value, at, F.lit(10_000)), F.array().cast("array<double>"))


def _bucketed(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with the number of ``__bounds`` up to a value, by binary search."""
    steps = F.array(*[F.lit(2 * BOUNDS >> k) for k in range((2 * BOUNDS).bit_length())])  # more than there are, ends included
    fits = lambda at, step: F.coalesce(F.get("__bounds", at + step - 1) <= F.col("__value"), F.lit(False))
    found = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(fits(at, step), step).otherwise(0))
    return df.withColumn("__value", value).withColumn(name, found).drop("__value")


def _all_known(values: list[Column]) -> Column:
    out = values[0].isNotNull()
    for v in values[1:]:
        out = out & v.isNotNull()
    return out
