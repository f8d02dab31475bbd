"""The types that attributes, rules and output columns can have."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from weft.errors import ProjectError

#: Declared name: type in casts.  Fixed values.
NAMES = {
    "string": "string",
    "decimal": "decimal(38,12)",
    "timestamp": "timestamp",
    "boolean": "boolean",
    "int": "int",
    "long": "bigint",
    "float": "float",
    "double": "double",
    "struct": "struct",
    "array": "array",
    "date": "date",
}
_OF = {
    T.StringType: "string", T.DecimalType: "decimal", T.TimestampType: "timestamp", T.BooleanType: "boolean", T.ByteType: "int", T.ShortType: "int",
    T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.StructType: "struct", T.ArrayType: "array", T.DateType: "date",
}
#: Names of rules, as the project format has them.  A fixed value.
IDENTIFIER = re.compile(r"^[a-z_]+[a-z0-9_]*$")


def name_of(kind: T.DataType) -> str | None:
    """The declared name of a Spark type, or None if a rule can't have it."""
    return _OF.get(type(kind))


def cast_type(name: str, where: str) -> str:
    """The type to cast to for a declared scalar type, in any case; ``integer`` and ``bigint`` are accepted."""
    low = {"integer": "int", "bigint": "long"}.get(name.strip().lower(), name.strip().lower())
    if low not in NAMES or low in ("struct", "array"):
        raise ProjectError("type", f"Invalid datatype {name!r}", where)
    return NAMES[low]


def nested(schema) -> T.DataType:
    """A struct or array type from Spark's JSON form."""
    kind = schema.get("type") if isinstance(schema, dict) else None
    if kind == "struct":
        return T.StructType.fromJson(schema)
    if kind == "array":
        return T.ArrayType.fromJson(schema)
    raise ProjectError("type", f"schema must be a struct or an array, not {schema!r}")
