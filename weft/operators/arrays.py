"""Arrays of structs as sources within a row: rules on their elements, and aggregates over them.

Everything stays in the row, by functions on arrays, so nothing is shuffled and the elements keep their order.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import types as T

from weft.errors import ProjectError
from weft.functions.lexer import Agg, Ref

#: The variable of an element.
ELEMENT = "__e"
_CALL = re.compile(r"\s*\w+\s*\(\s*(distinct\s+)?(.*)\)\s*", re.I | re.S)


def with_rules(array: str, fields: list[str], rules: dict[str, str]) -> str:
    """SQL for the array with the elements' ``fields`` and more, each by its SQL over the element."""
    parts = [f"'{f}', {ELEMENT}.`{f}`" for f in fields] + [f"'{n}', {sql}" for n, sql in rules.items()]
    return f"transform({array}, {ELEMENT} -> named_struct({', '.join(parts)}))"


def aggregate(a: Agg, array: str, kind_of: Callable[[str], T.DataType], where: str) -> str:
    """SQL for an aggregate over the elements; ``kind_of`` gives the type of an SQL text."""
    m = _CALL.fullmatch("".join(p if isinstance(p, str) else f"{ELEMENT}.`{p.attribute}`" for p in a.parts))
    if not m:
        raise ProjectError("aggregate", f"{a.name} over an array takes one argument and no FILTER", where)
    every = f"transform(coalesce({array}, array()), {ELEMENT} -> {m[2]})"
    known = f"filter({every}, v -> v IS NOT NULL)"
    if m[1]:
        known = f"array_distinct({known})"
    element = kind_of(every).elementType
    if isinstance(element, T.IntegralType):
        zero = "0L"
    elif isinstance(element, T.DecimalType):
        zero = "cast(0 as decimal(38,12))"
    else:
        zero = "0D"
    total = f"aggregate({known}, {zero}, (x, y) -> cast(x + y as {kind_of(zero).simpleString()}))"
    some = lambda sql: f"if(size({known}) = 0, NULL, {sql})"
    made = {
        "count": f"cast(size({known}) as bigint)",
        "count_if": f"cast(size(filter({every}, v -> v)) as bigint)",
        "sum": some(total),
        "min": f"array_min({known})",
        "max": f"array_max({known})",
        "collect_list": known,
        "collect_set": f"array_distinct({known})",
        "bool_or": some(f"exists({known}, v -> v)"),
        "bool_and": some(f"forall({known}, v -> v)"),
        "first": f"get({every}, 0)",
        "last": f"try_element_at({every}, -1)",
        "avg": some(f"cast({total} as double) / size({known})"),
    }
    same = {"mean": "avg", "array_agg": "collect_list", "any": "bool_or", "some": "bool_or", "every": "bool_and", "first_value": "first", "any_value": "first", "last_value": "last"}
    name = same.get(a.name, a.name)
    if name not in made:
        raise ProjectError("aggregate", f"{a.name} is not offered over an array", where)
    return made[name]


def element_text(parts: list, outer: Callable[[Ref], str]) -> str:
    """An element rule's SQL: ``[This]`` is the element, ``[Parent]`` the row."""
    return "".join(p if isinstance(p, str) else outer(p) if p.source else f"{ELEMENT}.`{p.attribute}`" for p in parts)
