"""One source with all its rules as a lazy DataFrame.

Level by level, what the level's rules need is joined - each path once, however many rules use it - and then all rules of
the level are computed in one ``select``.  Joined columns get names of their own, so that a source can be joined to itself
or in several roles.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.errors import ProjectError
from weft.functions import types
from weft.functions.aggregates import split_arguments
from weft.functions.lexer import Agg, Ref
from weft.model import Project, Relation, Source
from weft.operators import arrays
from weft.operators.manyjoin import aggregate, condition, quoted
from weft.operators.theta import has_equality, matches
from weft.plans.paths import Path, relation
from weft.plans.rules import levels, needs, sides

#: Prefix of columns that are not attributes; no attribute may begin so.
OWN = "__"
_CONCAT = re.compile(r"\s*concat\s*\((.*)\)\s*", re.I | re.S)
_OWN_COLUMN = re.compile(r"\s*\[this\]\.(\w+)\s*", re.I)
_SEPARATOR = re.compile(r"\s*'([^'\\0-9-]+)'\s*")


def parts_of(source: Source, attribute: str) -> list[tuple[str, bool]]:
    """Of a rule concat(number, 'text', number, ...) the columns and texts in turn, (name or text, is a column); else nothing.

    Texts must hold something that no number begins or goes on with, so that the whole can be taken apart in one way.
    """
    rule = source.rules.get(attribute)
    m = _CONCAT.fullmatch(rule.text) if rule is not None and not rule.unique and rule.cast is None and isinstance(rule.text, str) else None
    out: list[tuple[str, bool]] = []
    for k, part in enumerate(split_arguments(m[1]) if m else []):
        c = (_OWN_COLUMN if k % 2 == 0 else _SEPARATOR).fullmatch(part)
        if c is None or k % 2 == 0 and getattr(source.raw.get(c[1].lower()), "type", None) not in ("int", "long"):
            return []
        out.append((c[1].lower(), True) if k % 2 == 0 else (c[1], False))
    return out if len(out) % 2 else []


class Enrichment:
    def __init__(self, project: Project, source: Source, base: DataFrame, hub: Callable[[str], DataFrame], only: Iterable[str] | None = None, check_one: bool = False) -> None:
        self.project, self.source, self.hub, self.check_one = project, source, hub, check_one
        self.needs = needs(project, source)
        if only is not None:  # the wanted rules and what they need
            todo, kept = [n for n in only if n in self.needs], {}
            while todo:
                name = todo.pop()
                if name not in kept:
                    kept[name] = self.needs[name]
                    todo += [a for a in self.needs[name].own if a in self.needs]
            self.needs = kept
        self.levels = levels(source, self.needs)
        self.there: dict[Path, dict[str, str]] = {}  # joined paths: attribute -> column
        self.numbers: dict[Path, int] = {}
        missing = [n for n in source.raw if n not in {c.lower() for c in base.columns}]
        if missing:
            raise ProjectError("raw attribute", f"the table has no column {', '.join(missing)}", source.name)
        self.df = base.select(*[F.col(quoted(n)).alias(n) for n in source.raw])
        for raw in source.raw.values():
            self._element_rules(raw)
        self.steps: list[str] = []

    def _number(self, path: Path) -> int:
        return self.numbers.setdefault(path, len(self.numbers))

    def _end(self, r: Relation, forward: bool, name: str) -> DataFrame:
        """The rows at the end of a hop: another source's enriched rows, or this one's as far as they are staged."""
        if name == self.source.name:
            return self.df.select(*[c for c in self.df.columns if not c.startswith(OWN)])
        rows = self.hub(name)
        # a lookup by a unique rule finds only values that occur once; a hot value is folded in each task
        for a in sides(r, forward)[1]:
            rule = self.project.sources[name].rules.get(a)
            if rule is not None and rule.unique:
                row = F.struct(*[F.col(quoted(c)).alias(c) for c in rows.columns])
                each = rows.where(F.col(quoted(a)).isNotNull()).groupBy(F.col(quoted(a)).alias(f"{OWN}key")).agg(F.count(F.lit(1)).alias(f"{OWN}n"), F.first(row).alias(f"{OWN}row"))
                rows = each.where(F.col(f"{OWN}n") == 1).select(f"{OWN}row.*")
        return rows

    def _element_rules(self, raw) -> None:
        """The rules on the elements of an array, level by level."""
        left, fields = dict(raw.rules), [f.name for f in raw.schema.elementType.fields] if raw.rules else []
        while left:
            ready = [n for n, r in left.items() if not any(x.source is None and x.attribute in left for x in r.parsed.refs())]
            if not ready:
                raise ProjectError("rule cycle", f"rules need each other: {', '.join(left)}", f"[{self.source.name}].{raw.name}")
            texts = {n: arrays.element_text(left.pop(n).parsed.parts, lambda x: quoted(x.attribute)) for n in ready}
            self.df = self.df.withColumn(raw.name, F.expr(arrays.with_rules(quoted(raw.name), fields, texts)))
            fields += ready

    def _wanted(self, path: Path) -> list[str]:
        """Attributes at the end of a path that any rule needs, as values or as keys of the next hop."""
        out: set[str] = set()
        for n in self.needs.values():
            out.update(r.attribute for r, p in n.lookups.items() if p == path)
            for p in [*n.lookups.values(), *(p for _, p in n.aggregates)]:
                if len(p) > len(path) and p[: len(path)] == path:
                    nxt = p[len(path)]
                    out.update(sides(relation(self.project, nxt.relation), nxt.forward)[0])
        return sorted(out)

    def _start(self, path: Path, names: list[str]) -> dict[str, str]:
        if not path:
            return {a: a for a in names}
        return self._lookup(path)

    def _lookup(self, path: Path) -> dict[str, str]:
        """Join a path of "1" hops unless it is there."""
        if path in self.there:
            return self.there[path]
        hop, number = path[-1], self._number(path)
        r = relation(self.project, hop.relation)
        start_keys, end_keys = sides(r, hop.forward)
        start = self._start(path[:-1], start_keys)
        right = self._end(r, hop.forward, hop.end)
        pairs = self._parts(r, hop) if len(path) == 1 else []
        names = [a for a in sorted({*self._wanted(path), *end_keys, *(b for _, b in pairs)}) if a in right.columns]
        columns = {a: f"{OWN}j{number}_{a}" for a in names}
        right = right.select(*[F.col(quoted(a)).alias(c) for a, c in columns.items()])
        left = self.df.columns
        kept = [c for a, c in columns.items() if a in self._wanted(path)]
        several = F.raise_error(F.lit(f"{hop.relation}: several rows on a side declared 1"))
        if self.df.isStreaming or has_equality(r) and not (self.check_one and r.equal is None):
            if self.check_one and not self.df.isStreaming:  # NULL keys match nothing
                keys = [F.col(quoted(columns[a])) for a in end_keys]
                many = (F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1) & ~F.greatest(*[k.isNull() for k in keys], F.lit(False))
                right = right.withColumn(columns[end_keys[0]], F.when(many, several).otherwise(keys[0]))
            on = [F.col(quoted(a)) == F.col(quoted(columns[b])) for a, b in pairs] or condition(r, hop.forward, start, columns)
            self.df = self.df.join(right, on, "left").select(*left, *kept)
        else:
            # the distinct keys are matched first, so that no side need be broadcast for the outer join
            used = sorted({start[a] for a in start_keys})
            keys = [f"{OWN}t{number}_{i}" for i in range(len(used))]
            renamed = {a: keys[used.index(c)] for a, c in start.items() if c in used}
            ours = self.df.select(*[F.col(quoted(c)).alias(k) for c, k in zip(used, keys, strict=True)]).distinct()
            found = matches(ours, right, r, renamed, columns, hop.forward, condition(r, hop.forward, renamed, columns)).select(*keys, *kept)
            if self.check_one:
                many = F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1
                mark = keys[0]
                found = found.withColumn(mark, F.when(many, several).otherwise(F.col(mark)))
            on = [F.col(quoted(c)).eqNullSafe(F.col(k)) for c, k in zip(used, keys, strict=True)]
            self.df = self.df.join(found, on, "left").select(*left, *kept)
        self.steps.append(f"left join {hop.end} by {' '.join(h.relation for h in path)}: {', '.join(columns)}")
        self.there[path] = columns
        return columns

    def _parts(self, r: Relation, hop) -> list[tuple[str, str]]:
        """Where both keys are texts put together from whole numbers in the same way, the pairs of those numbers: equal
        texts are equal numbers, which are cheaper to compare and by which the other side may be grouped already."""
        if r.equal is None or len(r.equal) != 1 or hop.end == self.source.name:
            return []
        mine, theirs = r.equal[0] if hop.forward else r.equal[0][::-1]
        a, b = parts_of(self.source, mine), parts_of(self.project.sources[hop.end], theirs)
        if not a or not b or [x for x, is_column in a if not is_column] != [x for x, is_column in b if not is_column]:
            return []
        return [(x, y) for (x, is_column), (y, _) in zip(a, b, strict=True) if is_column]

    def _aggregates(self, path: Path, calls: dict[str, Agg]) -> None:
        hop = path[-1]
        r = relation(self.project, hop.relation)
        start_keys, end_keys = sides(r, hop.forward)
        start = self._start(path[:-1], start_keys)
        rows = self._end(r, hop.forward, hop.end)
        number = self._number(path)
        names = sorted({*end_keys, *(x.attribute for a in calls.values() for x in a.refs())})
        columns = {a: f"{OWN}m{number}_{a}" for a in names}
        rows = rows.select(*[F.col(quoted(a)).alias(c) for a, c in columns.items()])
        self.df = aggregate(self.df, rows, r, hop.forward, start, columns, calls, columns, f"{OWN}k{number}_{len(self.steps)}")
        self.steps.append(f"left join aggregates of {hop.end} by {' '.join(h.relation for h in path)}: {len(calls)} calls, {'grouped by key' if r.equal is not None else 'by condition'}")

    def run(self) -> DataFrame:
        for number, names in enumerate(self.levels):
            grouped: dict[Path, dict[str, Agg]] = {}
            slot: dict[int, str] = {}
            for name in names:
                n = self.needs[name]
                for path in n.lookups.values():
                    self._lookup(path)
                for a, path in n.aggregates:
                    calls = grouped.setdefault(path, {})
                    same = next((c for c, x in calls.items() if x.parts == a.parts), None)
                    slot[id(a)] = same or f"{OWN}a{number}_{self._number(path)}_{len(calls)}"
                    calls[slot[id(a)]] = a
            for path, calls in grouped.items():
                self._aggregates(path, calls)
            made: dict[str, Column] = {}
            for name in names:
                n = self.needs[name]
                for a, array in n.arrays:
                    slot[id(a)] = f"{OWN}s{number}_{len(slot)}"
                    inner = arrays.aggregate(a, quoted(array), lambda sql: self.df.select(F.expr(sql).alias("v")).schema["v"].dataType, n.rule.where)
                    self.df = self.df.withColumn(slot[id(a)], F.expr(inner))

                def column(ref: Ref, n=n) -> str:
                    return quoted(ref.attribute if ref.source is None else self.there[n.lookups[ref]][ref.attribute])

                made[name] = F.expr(n.rule.parsed.render(column, lambda a: quoted(slot[id(a)])))
            kinds = self._kinds(made)
            self.df = self.df.select("*", *[self._typed(self.needs[n].rule, v, kinds[n]).alias(n) for n, v in made.items()])
            for name in names:
                kind = self.df.schema[name].dataType
                if types.name_of(kind) is None:
                    raise ProjectError("type", f"Invalid rule expression: type {kind.simpleString()} is not offered", self.source.rules[name].where)
            self.steps.append(f"level {number}: {', '.join(names)}")
        return self.df.select(*[c for c in self.df.columns if not c.startswith(OWN)])

    def _kinds(self, made: dict[str, Column]) -> dict[str, T.DataType]:
        """The types of a level's rules by one analysis; only if that fails, rule by rule, to name the wrong one."""
        try:
            schema = self.df.select(*[v.alias(n) for n, v in made.items()]).schema
            return {n: schema[n].dataType for n in made}
        except Exception:  # noqa: BLE001  whatever it is, it is raised again below or by the level's select
            for name, value in made.items():
                try:
                    self.df.select(value.alias("v")).schema
                except AnalysisException as e:
                    raise ProjectError("expression", f"Invalid rule expression: {str(e).splitlines()[0]}", self.needs[name].rule.where) from e
            raise

    def _typed(self, rule, value: Column, kind: T.DataType) -> Column:
        """The cast that was asked for; any decimal becomes the catalogue's decimal."""
        if rule.cast:
            return value.cast(rule.cast)
        return value.cast(types.NAMES["decimal"]) if isinstance(kind, T.DecimalType) else value
