"""The schema that a group of JSON texts has in common, as Spark writes it: two functions on plain columns.

The first gives the schema of one text; the different ones of a group, which are few, are gathered by ``collect_set`` and
merged by the second.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _of(value):
    """A type as nested tuples that can be compared: name, or ("array", type), or ("struct", ((field, type), ...))."""
    if value is None:
        return "void"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "bigint" if -(2**63) <= value < 2**63 else "double"
    if isinstance(value, float):
        return "double"
    if isinstance(value, str):
        return "string"
    if isinstance(value, list):
        out = "void"
        for x in value:
            out = merged(out, _of(x))
        return ("array", out)
    return ("struct", tuple(sorted((k, _of(v)) for k, v in value.items())))


def merged(a, b):
    """The narrowest type that holds both; what doesn't fit together is a string."""
    if a == b or b == "void":
        return a
    if a == "void":
        return b
    if {a, b} == {"bigint", "double"}:
        return "double"
    if isinstance(a, tuple) and isinstance(b, tuple) and a[0] == b[0]:
        if a[0] == "array":
            return ("array", merged(a[1], b[1]))
        x, y = dict(a[1]), dict(b[1])
        return ("struct", tuple((k, merged(x.get(k, "void"), y.get(k, "void"))) for k in sorted({*x, *y})))
    return "string"


def _ddl(kind) -> str:
    if isinstance(kind, tuple):
        if kind[0] == "array":
            return f"ARRAY<{_ddl(kind[1])}>"
        return "STRUCT<" + ", ".join(f"{k}: {_ddl(t)}" if k.isidentifier() else f"`{k}`: {_ddl(t)}" for k, t in kind[1]) + ">"
    return {"void": "STRING"}.get(kind, kind.upper())


def _tuples(x):
    return (x[0], _tuples(x[1]) if x[0] == "array" else tuple((k, _tuples(t)) for k, t in x[1])) if isinstance(x, list) else x


def schema_of(texts: pd.Series) -> pd.Series:
    out = []
    for t in texts:
        try:
            out.append(None if t is None else json.dumps(_of(json.loads(t))))
        except ValueError:
            out.append(None)
    return pd.Series(out, dtype=object)


def merge(groups: pd.Series) -> pd.Series:
    out = []
    for schemas in groups:
        kind = "void"
        for s in schemas if schemas is not None else ():
            kind = merged(kind, _tuples(json.loads(s)))
        out.append(_ddl(kind) if schemas is not None and len(schemas) else None)
    return pd.Series(out, dtype=object)


def register(spark: SparkSession) -> None:
    spark.udf.register("weft_schema_of_json", F.pandas_udf(schema_of, "string"))
    spark.udf.register("weft_merge_schemas", F.pandas_udf(merge, "string"))
