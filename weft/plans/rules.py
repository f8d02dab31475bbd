"""What each rule needs, the levels in which rules can be computed, and the order of sources."""

from __future__ import annotations

from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from weft.errors import ProjectError
from weft.functions.lexer import Agg, Ref
from weft.model import Project, Relation, Rule, Source
from weft.plans.paths import Path, relation, resolve


@dataclass
class Need:
    """Resolved references of a rule: the path of each foreign one, and of each aggregate."""

    rule: Rule
    lookups: dict[Ref, Path] = field(default_factory=dict)
    aggregates: list[tuple[Agg, Path]] = field(default_factory=list)
    arrays: list[tuple[Agg, str]] = field(default_factory=list)  # aggregates over an array of the source itself
    own: set[str] = field(default_factory=set)  # attributes of the source itself that must be there before


def sides(r: Relation, forward: bool) -> tuple[list[str], list[str]]:
    """The attributes of a hop's start and of its end."""
    return r.keys(not forward), r.keys(forward)


def _explicit(rule: Rule, source: str, foreign: set[str]) -> list[str]:
    for p in rule.parameters:
        named = p.get("source_name")
        if named == source or named is None and len(foreign) == 1:
            return [str(x) for x in p.get("relations") or []]
    return []


def need(project: Project, source: Source, rule: Rule) -> Need:
    e, out = rule.parsed, Need(rule)
    refs = e.refs() + [r for a in e.aggs() for r in a.refs()]
    if any(r.related for r in refs):
        raise ProjectError("reference", "[Related] belongs to relations only", rule.where)
    within = {n: raw.fields() for n, raw in source.raw.items() if raw.fields() and n not in project.sources}
    for r in refs:
        if r.source in within:
            if r.attribute not in within[r.source]:
                raise ProjectError("unknown attribute", f"unknown attribute [{r.source}].{r.attribute}", rule.where)
            continue
        project.ref(source, r, rule.where)
        if r.source is None and r.attribute == rule.name:
            raise ProjectError("self-reference", "a rule can't refer to itself", rule.where)
    foreign = {r.source for r in refs if r.source and r.source not in within}
    for r in e.refs():
        if r.source is None:
            out.own.add(r.attribute)
        elif r.source in within:
            raise ProjectError("cardinality", f"must use aggregation: {r.source} is an array", rule.where)
        else:
            out.lookups[r] = resolve(project, source.name, r.source, True, _explicit(rule, r.source, foreign), rule.where)
    for a in e.aggs():
        inner = {r.source for r in a.refs()}
        if not inner:
            raise ProjectError("aggregate", f"aggregate {a.name} has no attribute", rule.where)
        if None in inner:
            raise ProjectError("aggregate", f"aggregate {a.name} on [This]", rule.where)
        if len(inner) > 1:
            raise ProjectError("aggregate", f"aggregate {a.name} uses several paths: {', '.join(sorted(inner))}", rule.where)
        (target,) = inner
        if target in within:
            out.arrays.append((a, target))
            continue
        out.aggregates.append((a, resolve(project, source.name, target, False, _explicit(rule, target, foreign), rule.where)))
    for path in [*out.lookups.values(), *(p for _, p in out.aggregates)]:
        out.own.update(a for a in sides(relation(project, path[0].relation), path[0].forward)[0])
        for hop in path:  # a hop into the source itself reads its staged rows
            if hop.end == source.name:
                out.own.update(sides(relation(project, hop.relation), hop.forward)[1])
    for r, path in out.lookups.items():
        if path[-1].end == source.name:
            out.own.add(r.attribute)
    for a, path in out.aggregates:
        if path[-1].end == source.name:
            out.own.update(r.attribute for r in a.refs())
    if source.stream:
        if e.windowed or rule.unique or out.aggregates:
            raise ProjectError("stream", "a rule of a stream can't use windows, uniqueness or aggregates", rule.where)
        if any(h.end == source.name for p in out.lookups.values() for h in p):
            raise ProjectError("stream", "a rule of a stream can't look up the stream itself", rule.where)
    return out


def needs(project: Project, source: Source) -> dict[str, Need]:
    return {name: need(project, source, rule) for name, rule in source.rules.items()}


def levels(source: Source, wanted: dict[str, Need]) -> list[list[str]]:
    """Rules by level: a rule is one above the highest rule that it needs."""
    graph = {name: sorted(n.own & wanted.keys()) for name, n in wanted.items()}
    try:
        order = list(TopologicalSorter(graph).static_order())
    except CycleError as e:
        raise ProjectError("rule cycle", f"rules need each other: {' -> '.join(e.args[1])}", source.name) from None
    level: dict[str, int] = {}
    for name in order:
        level[name] = 1 + max((level[p] for p in graph[name]), default=-1)
    return [sorted(n for n in level if level[n] == k) for k in range(1 + max(level.values(), default=-1))]


def reads(source: Source, wanted: dict[str, Need]) -> set[str]:
    """Other sources whose enriched rows a source needs."""
    paths = [p for n in wanted.values() for p in [*n.lookups.values(), *(p for _, p in n.aggregates)]]
    return {h.end for p in paths for h in p} - {source.name}


def build_order(project: Project) -> list[str]:
    graph = {s.name: sorted(reads(s, needs(project, s))) for s in project.sources.values()}
    try:
        return list(TopologicalSorter(graph).static_order())
    except CycleError as e:
        raise ProjectError("source cycle", f"circular references between sources: {' -> '.join(e.args[1])}") from None


def check(project: Project) -> None:
    """All errors of planning."""
    for s in project.sources.values():
        levels(s, needs(project, s))
    build_order(project)
