"""A project: sources with attributes and rules, relations between them, and outputs."""

from __future__ import annotations

import re
from collections.abc import Callable
from collections.abc import Mapping as Dict
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame

from weft.errors import ProjectError
from weft.functions import aggregates, types
from weft.functions.lexer import Expression, Ref, parse

_RELATION = re.compile(r"^\[([^\[\]]+)\]-(.+)-\[([^\[\]]+)\]$", re.S)
_PATH = r"(?:\[this\]\.)?([\w`]+)((?:\.[\w`]+)*)"
_PLAIN = re.compile(rf"^{_PATH}\s+(\S+)$", re.I)
_CALL = re.compile(rf"^(\w+)\s*\(\s*(distinct\s+)?{_PATH}\s*\)\s+(\S+)$", re.I)


def _active(spec: Dict) -> bool:
    return bool(spec.get("active_flag", True))


@dataclass
class Raw:
    """A declared column.  ``rules`` add fields to the elements of an array of structs."""

    name: str
    type: str
    schema: object = None
    rules: dict[str, Rule] = field(default_factory=dict)

    def fields(self) -> set[str]:
        """The fields of an array's elements; none for other types."""
        element = getattr(self.schema, "elementType", None)
        return {f.name for f in getattr(element, "fields", ())} | self.rules.keys()

    @classmethod
    def of(cls, spec, where: str) -> Raw:
        if isinstance(spec, Dict):
            kind = types.nested(spec.get("schema"))
            out = cls(str(spec["name"]).lower(), types.name_of(kind), kind)
            for r in spec.get("rules") or []:
                rule = Rule.of(r, f"{where}].[{out.name}")
                if not out.fields():
                    raise ProjectError("rule", "only an array of structs has rules on its elements", rule.where)
                if rule.name in out.fields():
                    raise ProjectError("duplicate", f"attribute {rule.name} is declared twice", rule.where)
                if rule.parsed.aggs() or rule.parsed.windowed or any(x.source not in (None, "Parent") for x in rule.parsed.refs()):
                    raise ProjectError("rule", "a rule on elements can use [This] and [Parent] attributes only", rule.where)
                out.rules[rule.name] = rule
            for rule in out.rules.values():
                for x in rule.parsed.refs():
                    if x.source is None and (x.attribute not in out.fields() or x.attribute == rule.name):
                        raise ProjectError("unknown attribute", f"unknown attribute [This].{x.attribute}", rule.where)
            return out
        words = str(spec).split()
        if len(words) != 2 or words[1].lower() not in types.NAMES:
            raise ProjectError("raw attribute", f"{spec!r} is not a name and a type", where)
        return cls(words[0].lower(), words[1].lower())


@dataclass
class Rule:
    name: str
    text: str
    where: str
    cast: str | None = None
    kind: str = "E"
    action: str | None = None
    unique: bool = False
    keep_current: bool | None = None
    active: bool = True
    parameters: list[dict] = field(default_factory=list)

    @classmethod
    def of(cls, spec: Dict, source: str) -> Rule:
        name = str(spec.get("name", ""))
        where = f"[{source}].{name}"
        if not types.IDENTIFIER.match(name):
            raise ProjectError("rule name", f"Invalid rule name {name!r}", where)
        kind, action = str(spec.get("rule_type_code", "E")).upper(), spec.get("validation_action_code")
        if kind not in ("E", "V") or kind == "V" and str(action or "W").upper() not in ("F", "W"):
            raise ProjectError("rule type", f"rule type {kind} with action {action}", where)
        cast = spec.get("cast_datatype")
        rule = cls(name, spec.get("expression"), where, types.cast_type(cast, where) if cast else None, kind, str(action or "W").upper() if kind == "V" else None,
                   bool(spec.get("unique_flag", False)), spec.get("keep_current_flag"), _active(spec), list(spec.get("parameters") or []))
        if rule.parsed.windowed and rule.keep_current is False:
            raise ProjectError("window", "a window rule must be keep-current", where)
        return rule

    @cached_property
    def parsed(self) -> Expression:
        return parse(self.text, self.where)


@dataclass
class Source:
    name: str
    table: str | None
    query: str | None = None
    target: str | None = None
    raw: dict[str, Raw] = field(default_factory=dict)
    rules: dict[str, Rule] = field(default_factory=dict)
    stream: bool = False
    unmanaged: bool = False
    #: The table itself, or a function that gives it when it is first needed.
    frame: DataFrame | Callable[[], DataFrame] | None = None

    @classmethod
    def of(cls, spec: Dict) -> Source:
        name = str(spec.get("source_name") or "")
        if not name:
            raise ProjectError("source", "source_name is missing")
        if not (spec.get("source_table") or spec.get("source_query") or spec.get("frame") is not None):
            raise ProjectError("source", "source_table is missing", name)
        table = spec.get("source_table")
        target = spec.get("target_table") or (name if str(table).lower() != name.lower() else f"enriched_{name}")
        out = cls(name, table, spec.get("source_query"), target,
                  stream=spec.get("processing_type") == "stream", unmanaged=spec.get("refresh_type") == "unmanaged", frame=spec.get("frame"))
        for r in spec.get("raw_attributes") or []:
            raw = Raw.of(r, name)
            if raw.name in out.raw:
                raise ProjectError("duplicate", f"attribute {raw.name} is declared twice", name)
            out.raw[raw.name] = raw
        if not out.raw:
            raise ProjectError("raw attribute", "no raw attributes", name)
        for raw in out.raw.values():
            for rule in raw.rules.values():
                for x in rule.parsed.refs():
                    if x.source == "Parent" and x.attribute not in out.raw:
                        raise ProjectError("unknown attribute", f"unknown attribute [Parent].{x.attribute}", rule.where)
        for r in spec.get("rules") or []:
            rule = Rule.of(r, name)
            if rule.name in out.raw or rule.name in out.rules:
                raise ProjectError("duplicate", f"attribute {rule.name} is declared twice", name)
            if rule.active:
                out.rules[rule.name] = rule
        return out

    def has(self, attribute: str) -> bool:
        return attribute in self.raw or attribute in self.rules


@dataclass
class Relation:
    name: str
    this: str
    related: str
    expression: Expression
    cardinality: tuple[str, str]
    primary: bool = True

    @classmethod
    def of(cls, spec: Dict) -> Relation:
        name = str(spec.get("name") or "")
        m = _RELATION.match(name.strip())
        if not m:
            raise ProjectError("relation", "a relation's name is [Source]-text-[Source]", name)
        card = re.fullmatch(r"\s*([M1])\s*-\s*([M1])\s*", str(spec.get("cardinality") or ""), re.I)
        if not card:
            raise ProjectError("relation", f"Invalid cardinality {spec.get('cardinality')!r}", name)
        e = parse(spec.get("expression"), name)
        refs = e.refs()
        if e.aggs() or any(r.source for r in refs) or not {False, True} <= {r.related for r in refs}:
            raise ProjectError("relation", "expression must use [This] and [Related] attributes only, at least one of each", name)
        return cls(name, m[1], m[3], e, (card[1].upper(), card[2].upper()), bool(spec.get("primary_flag", True)))

    def keys(self, related: bool) -> list[str]:
        return list(dict.fromkeys(r.attribute for r in self.expression.refs() if r.related == related))

    @cached_property
    def equal(self) -> list[tuple[str, str]] | None:
        """[(attribute of This, attribute of Related)] if the expression is nothing but such equalities."""
        text = self.expression.render(lambda r: f"\0{'R' if r.related else 'T'}{r.attribute}\0")
        pairs = []
        for part in re.split(r"\s+and\s+", text, flags=re.I):
            m = re.fullmatch(r"\s*\(?\s*\0([RT])(\w+)\0\s*={1,2}\s*\0([RT])(\w+)\0\s*\)?\s*", part)
            if not m or m[1] == m[3] or part.count("(") != part.count(")"):
                return None
            pairs.append((m[2], m[4]) if m[1] == "T" else (m[4], m[2]))
        return pairs


@dataclass
class Mapping:
    column: str
    path: str
    aggregate: str | None = None
    distinct: bool = False

    @property
    def attribute(self) -> str:
        return self.path.split(".")[0].strip("`").lower()

    @classmethod
    def of(cls, text: str, aggregated: bool, where: str) -> Mapping:
        text = str(text).strip()
        if m := _CALL.match(text):
            name = m[1].lower()
            if name not in aggregates.NAMES or name in aggregates.REJECTED:
                raise ProjectError("mapping", f"unknown aggregate {m[1]}", where)
            if not aggregated:
                raise ProjectError("mapping", "aggregates need operation_type: Aggregate", where)
            return cls(m[5], m[3].lower() + m[4], name, bool(m[2]))
        if m := _PLAIN.match(text):
            return cls(m[3], m[1].lower() + m[2])
        raise ProjectError("mapping", f"can't read mapping {text!r}", where)


@dataclass
class Channel:
    name: str
    source: str
    filter: Expression | None
    aggregated: bool
    mappings: dict[str, Mapping]
    statuses: tuple[str, ...]
    #: Attributes that become rows, under ``unpivot_name`` and ``unpivot_value``.
    unpivot: tuple[str, ...] = ()


#: What a mapping can name besides attributes in a channel that unpivots.
UNPIVOTED = ("unpivot_name", "unpivot_value")


@dataclass
class Output:
    name: str
    columns: dict[str, str]
    channels: list[Channel]
    table: str
    kind: str = "table"

    @classmethod
    def of(cls, spec: Dict) -> Output:
        name = str(spec.get("output_name") or "")
        columns: dict[str, str] = {}
        for c in spec.get("columns") or []:
            words = str(c).split()
            if words[0] in columns:
                raise ProjectError("output", f"column {words[0]} is declared twice", name)
            columns[words[0]] = types.cast_type(words[1] if len(words) > 1 else "string", f"{name}.{words[0]}")
        if not name or not columns:
            raise ProjectError("output", "an output needs output_name and columns", name)
        channels: list[Channel] = []
        for c in spec.get("channels") or []:
            if not _active(c):
                continue
            operation = str(c.get("operation_type") or "none").lower()
            if operation not in ("none", "aggregate", "unpivot"):
                raise ProjectError("output", f"operation_type {c['operation_type']} is not supported", name)
            turned = tuple(str(x).lower() for x in c.get("unpivot_columns") or ())
            if bool(turned) != (operation == "unpivot"):
                raise ProjectError("output", "operation_type: Unpivot and unpivot_columns belong together", name)
            source = str(c["source_name"])
            number = sum(x.source == source for x in channels) + 1
            label = source if number == 1 else f"{source} {number}"
            mappings: dict[str, Mapping] = {}
            for text in c.get("mappings") or []:
                m = Mapping.of(text, operation == "aggregate", f"{name}/{label}")
                if m.column not in columns:
                    raise ProjectError("mapping", f"column {m.column} is not declared", f"{name}/{label}")
                if m.column in mappings:
                    raise ProjectError("mapping", f"column {m.column} is mapped twice", f"{name}/{label}")
                mappings[m.column] = m
            where = parse(c["filter"], f"{name}/{label}") if c.get("filter") else None
            if where and (where.aggs() or any(r.source for r in where.refs())):
                raise ProjectError("filter", "a filter can use [This] attributes only", f"{name}/{label}")
            flags = {"P": c.get("include_pass_flag", True), "W": c.get("include_warn_flag", True), "F": c.get("include_fail_flag", False)}
            if not any(flags.values()):
                raise ProjectError("output", "at least one of pass, warn and fail must be included", f"{name}/{label}")
            channels.append(Channel(label, source, where, operation == "aggregate", mappings, tuple(k for k, v in flags.items() if v), turned))
        if not channels:
            raise ProjectError("output", "no active channels", name)
        table = spec.get("table_name") or name
        return cls(name, columns, channels, f"{spec['schema_name']}.{table}" if spec.get("schema_name") else table, spec.get("output_type", "table"))


@dataclass
class Project:
    sources: dict[str, Source]
    relations: list[Relation]
    outputs: dict[str, Output]
    functions: dict[str, tuple] = field(default_factory=dict)

    def register_function(self, name: str, function, returns=None) -> None:
        """A function of Python that rules can call: a (pandas) UDF, or a callable and its return type."""
        if not types.IDENTIFIER.match(name) or name in aggregates.NAMES:
            raise ProjectError("function", f"Invalid function name {name!r}")
        self.functions[name] = (function, returns)

    @classmethod
    def of(cls, sources, relations=(), outputs=()) -> Project:
        """From dictionaries of the project files' form; all errors that need no data are raised here."""
        from weft.plans.rules import check

        found: dict[str, Source] = {}
        for s in sources:
            source = Source.of(s)
            if source.name in found:
                raise ProjectError("duplicate", f"source {source.name} is declared twice")
            found[source.name] = source
        made = [Relation.of(r) for r in relations if _active(r)]
        for r in made:
            for name, related in ((r.this, False), (r.related, True)):
                if name not in found:
                    raise ProjectError("relation", f"unknown source {name}", r.name)
                for a in r.keys(related):
                    if not found[name].has(a):
                        raise ProjectError("relation", f"unknown attribute [{name}].{a}", r.name)
        if len({r.name for r in made}) < len(made):
            raise ProjectError("duplicate", "a relation is declared twice")
        outs: dict[str, Output] = {}
        for o in outputs:
            if not _active(o):
                continue
            out = Output.of(o)
            if out.name in outs or out.table in {x.table for x in outs.values()}:
                raise ProjectError("duplicate", f"output {out.name} or its table is declared twice")
            for c in out.channels:
                if c.source not in found:
                    raise ProjectError("output", f"unknown source {c.source}", out.name)
                used = [*c.unpivot, *(m.attribute for m in c.mappings.values() if not (c.unpivot and m.attribute in UNPIVOTED))] + [r.attribute for r in (c.filter.refs() if c.filter else [])]
                for a in used:
                    if not found[c.source].has(a):
                        raise ProjectError("output", f"unknown attribute [{c.source}].{a}", f"{out.name}/{c.name}")
            outs[out.name] = out
        read = {str(s.table).lower() for s in found.values() if s.table}
        for where, table in [(s.name, s.target) for s in found.values() if not s.unmanaged] + [(o.name, o.table) for o in outs.values()]:
            if str(table).lower() in read:
                raise ProjectError("target", f"{table} is read by the project and can't be written", where)
        if len(targets := [str(s.target).lower() for s in found.values()] + [o.table.lower() for o in outs.values()]) > len(set(targets)):
            raise ProjectError("duplicate", f"several write to {', '.join(sorted({t for t in targets if targets.count(t) > 1}))}")
        project = cls(found, made, outs)
        check(project)
        return project

    def ref(self, owner: Source, ref: Ref, where: str) -> Source:
        source = owner if ref.source is None else self.sources.get(ref.source)
        if source is None:
            raise ProjectError("unknown source", f"unknown source {ref.source}", where)
        if not source.has(ref.attribute):
            raise ProjectError("unknown attribute", f"unknown attribute [{source.name}].{ref.attribute}", where)
        return source
