"""Aggregates over the rows on the many side of a relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import aggregates
from weft.functions.lexer import Agg, Ref
from weft.model import Relation
from weft.operators.theta import cumulated, matches


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def condition(r: Relation, forward: bool, start: dict[str, str], end: dict[str, str]) -> Column:
    """The relation's expression over columns: ``start`` and ``end`` give the column of an attribute on either side."""

    def column(ref: Ref) -> str:
        return quoted((end if ref.related == forward else start)[ref.attribute])

    return F.expr(r.expression.render(column))


def aggregate(df: DataFrame, many: DataFrame, r: Relation, forward: bool, start: dict[str, str], end: dict[str, str], calls: dict[str, Agg], value: dict[str, str], mark: str) -> DataFrame:
    """``df`` with a column for each of ``calls``; all calls share one join.

    For equalities ``many`` is grouped by its keys and joined once.  For other conditions the distinct keys of ``df`` are
    matched with ``many`` (see :mod:`weft.operators.theta`), grouped, and joined back; if the condition is one comparison, calls
    that can be merged need no matches.  Either way a row without matches gets what the call yields over no
    rows; ``mark`` names a column that tells such rows.
    """
    sqls = {c: aggregates.compiled(a.name, "".join(p if isinstance(p, str) else quoted(value[p.attribute]) for p in a.parts)) for c, a in calls.items()}
    out = [F.expr(v).alias(c) for c, v in sqls.items()] + [F.lit(True).alias(mark)]
    if (pairs := r.equal) is not None:
        pairs = [(start[a], end[b]) if forward else (start[b], end[a]) for a, b in pairs]
        keys = [f"{mark}_{i}" for i in range(len(pairs))]
        grouped = many.groupBy(*[F.col(quoted(b)).alias(k) for (_, b), k in zip(pairs, keys, strict=True)]).agg(*out)
        on = [F.col(quoted(a)) == F.col(k) for (a, _), k in zip(pairs, keys, strict=True)]
    else:
        used = sorted({start[a] for a in r.keys(not forward)})
        keys = [f"{mark}_{i}" for i in range(len(used))]
        ours = df.select(*[F.col(quoted(c)).alias(k) for c, k in zip(used, keys, strict=True)]).distinct()
        renamed = {a: keys[used.index(c)] for a, c in start.items() if c in used}
        kinds = many.agg(*out).schema
        parts = {c: aggregates.in_parts(calls[c].name, v) for c, v in sqls.items()}
        parts = {c: p for c, p in parts.items() if len(p) == 1 or p and isinstance(kinds[c].dataType, T.DoubleType)}
        each = {f"{c}_{i}": x for c, p in parts.items() for i, x in enumerate(p)} | {mark: ("max(true)", "max")}
        grouped = cumulated(ours, many, r, renamed, end, forward, each) if parts else None
        if grouped is not None:
            done = [(F.try_divide(f"{c}_0", f"{c}_1") if len(p) == 2 else F.col(f"{c}_0")).cast(kinds[c].dataType).alias(c) for c, p in parts.items()]
            grouped = grouped.where(mark).select(*keys, mark, *done)
        if grouped is None or len(parts) < len(calls):
            rest = [v for v, c in zip(out, [*calls, mark], strict=True) if grouped is None or c not in parts and c != mark]
            pairs = matches(ours, many, r, renamed, end, forward, condition(r, forward, renamed, end)).groupBy(*keys).agg(*rest)
            grouped = pairs if grouped is None else grouped.join(pairs, keys)
        on = [F.col(quoted(c)).eqNullSafe(F.col(k)) for c, k in zip(used, keys, strict=True)]
    joined = df.join(grouped, on, "left")
    filled = {}
    for c, a in calls.items():
        if a.name in aggregates.EMPTY:
            kind = grouped.schema[c].dataType
            empty = F.expr(aggregates.EMPTY[a.name]).cast(kind)
            filled[c] = F.when(F.col(mark).isNull(), empty).otherwise(F.col(c)).alias(c)
    return joined.select(*df.columns, *[filled.get(c, F.col(c)) for c in calls])
