"""Outputs: channels filtered, aggregated and united by position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.errors import ProjectError
from weft.functions import aggregates
from weft.model import UNPIVOTED, Channel, Mapping, Output, Source
from weft.operators.manyjoin import quoted

STATUS = "validation_status"


def status(source: Source) -> Column:
    """F if a failing rule is not true, else W if a warning one is not, else P.  NULL counts as not true."""
    out = F.lit("P")
    for action in ("W", "F"):
        rules = [r for r in source.rules.values() if r.kind == "V" and r.action == action]
        if rules:
            good = reduce(lambda a, b: a & b, (F.coalesce(F.col(quoted(r.name)), F.lit(False)) for r in rules))
            out = F.when(~good, F.lit(action)).otherwise(out)
    return out


def _path(m: Mapping) -> Column:
    return F.col(".".join(quoted(k.strip("`")) for k in m.path.split(".")))


def _value(m: Mapping) -> Column:
    if m.aggregate is None:
        return _path(m)
    path = ".".join(quoted(k.strip("`")) for k in m.path.split("."))
    return F.expr(aggregates.compiled(m.aggregate, f"{m.aggregate}({'distinct ' if m.distinct else ''}{path})"))


def channel(out: Output, c: Channel, rows: DataFrame, source: Source, by_status: bool) -> DataFrame:
    if c.filter is not None:
        text = c.filter.render(lambda r: quoted(r.attribute))
        wanted = F.expr(text)
        if rows.select(wanted.alias("w")).schema["w"].dataType.simpleString() != "boolean":
            raise ProjectError("filter", f"a filter must be boolean: {text}", f"{out.name}/{c.name}")
        rows = rows.where(wanted)
    if by_status:
        rows = rows.where(status(source).isin(*c.statuses))
    if c.unpivot:
        rows = rows.select("*", F.inline(F.array(*[F.struct(F.lit(a).alias(UNPIVOTED[0]), F.col(quoted(a)).alias(UNPIVOTED[1])) for a in c.unpivot])))
    if c.aggregated:
        keys = [m for m in c.mappings.values() if m.aggregate is None]
        named = {m.column: f"k{i}" for i, m in enumerate(keys)}
        aggs = [_value(m).alias(f"a{i}") for i, m in enumerate(c.mappings.values()) if m.aggregate]
        named |= {m.column: f"a{i}" for i, m in enumerate(c.mappings.values()) if m.aggregate}
        grouped = rows.groupBy(*[_path(m).alias(named[m.column]) for m in keys]) if keys else rows
        rows = grouped.agg(*aggs) if aggs else rows.select(*[_path(m).alias(named[m.column]) for m in keys]).distinct()
        values = {column: F.col(n) for column, n in named.items()}
    else:
        values = {m.column: _path(m) for m in c.mappings.values()}
    return rows.select(*[values.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in out.columns.items()])


def output(out: Output, parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)
