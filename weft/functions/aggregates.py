"""The aggregate functions that rules and outputs may call."""

from __future__ import annotations

import re

#: All recognised names.
NAMES = frozenset(
    "any any_value approx_count_distinct approx_percentile array_agg avg bit_or bit_xor bool_and bool_or collect_list collect_set corr count count_if count_min_sketch "
    "covar_pop covar_samp every first first_value kurtosis last last_value max max_by mean median min min_by mode percentile percentile_approx schema_of_json_agg skewness some "
    "std stddev stddev_pop stddev_samp sum var_pop var_samp variance".split()
)
#: What a call yields over no rows, where that isn't NULL.
EMPTY = {"count": "0L", "count_if": "0L", "approx_count_distinct": "0L", "collect_list": "array()", "collect_set": "array()", "array_agg": "array()"}
#: Calls whose values over parts of the rows make up the value over all of them, and by which function.
MERGED = {"count": "sum", "count_if": "sum", "sum": "sum", "min": "min", "max": "max", "bit_or": "bit_or", "bit_xor": "bit_xor"}
MERGED |= dict.fromkeys(("bool_and", "every"), "bool_and") | dict.fromkeys(("any", "bool_or", "some"), "bool_or")
#: Known to the language, but not offered by Spark or outside the types that a rule can have.
REJECTED = {"count_min_sketch": "yields a binary value, which no rule can have"}


_ARGUMENTS = re.compile(r"\s*(\w+)\s*\(\s*(distinct\s+)?(.*?)\)\s*(filter\s*\(.*\))?\s*", re.I | re.S)


def split_arguments(text: str) -> list[str]:
    """Arguments at commas outside brackets and quotes."""
    out, depth, quote, at = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]]


def compiled(name: str, sql: str) -> str:
    """The SQL of a call as Spark is asked for it.

    Spark's corr fails over rows without spread, where SQL has NULL, so it is made of its parts.  Schemas of JSON are
    found row by row, and only the different ones of a group are merged.
    """
    if name not in ("corr", "schema_of_json_agg"):
        return sql
    m = _ARGUMENTS.fullmatch(sql)
    arguments = split_arguments(m[3]) if m else []
    if name == "corr" and m and len(arguments) == 2 and not m[2]:
        x, y, only = *arguments, m[4] or ""
        spread = f"stddev_pop(if(({y}) IS NULL, NULL, {x})) {only} * stddev_pop(if(({x}) IS NULL, NULL, {y})) {only}"
        return f"try_divide(covar_pop({x}, {y}) {only}, {spread})"
    if name == "schema_of_json_agg" and m and len(arguments) == 1:
        return f"weft_merge_schemas(collect_set(weft_schema_of_json({arguments[0]})) {m[4] or ''})"
    return sql


def in_parts(name: str, sql: str) -> list[tuple[str, str]]:
    """Calls over parts of the rows, each with the function that merges its values; two are divided.  Empty if there are none."""
    m = _ARGUMENTS.fullmatch(sql)
    if m is None or m[2]:
        return []
    if name in ("avg", "mean"):
        return [(f"{call} {m[4] or ''}", "sum") for call in (f"sum(cast({m[3]} AS double))", f"count({m[3]})")]
    return [(sql, MERGED[name])] if name in MERGED else []
