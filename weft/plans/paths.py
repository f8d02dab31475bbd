"""Paths from a source over relations.

A hop leads from one end of a relation to the other and has the cardinality declared there: "1" adds no rows, "M" needs an
aggregate.  All hops of a path but the last are "1".
"""

from __future__ import annotations

from dataclasses import dataclass

from weft.errors import ProjectError
from weft.model import Project, Relation

#: Longest path that is searched, unless an explicit path is longer.
DEPTH = 5


@dataclass(frozen=True)
class Hop:
    relation: str
    forward: bool
    start: str
    end: str
    one: bool


Path = tuple[Hop, ...]


def hops(project: Project, source: str) -> list[Hop]:
    out = []
    for r in project.relations:
        if r.this == source:
            out.append(Hop(r.name, True, r.this, r.related, r.cardinality[1] == "1"))
        if r.related == source and r.this != r.related:
            out.append(Hop(r.name, False, r.related, r.this, r.cardinality[0] == "1"))
    return out


def relation(project: Project, name: str) -> Relation | None:
    return next((r for r in project.relations if r.name == name), None)


def search(project: Project, source: str, target: str, one: bool, longest: int = DEPTH, again: tuple[str, ...] = ()) -> list[Path]:
    """All paths to ``target`` whose last hop is a "1" or an "M" as asked.  No relation is used twice but those of ``again``."""
    found: list[Path] = []
    todo: list[Path] = [()]
    while todo:
        path = todo.pop()
        for hop in hops(project, path[-1].end if path else source):
            used = sum(h.relation == hop.relation for h in path)
            if used and used >= again.count(hop.relation):
                continue
            longer = (*path, hop)
            if hop.end == target and hop.one == one:
                found.append(longer)
            if hop.one and len(longer) < longest:
                todo.append(longer)
    return sorted(found, key=lambda p: (len(p), [h.relation for h in p]))


def resolve(project: Project, source: str, target: str, one: bool, explicit: list[str], where: str) -> Path:
    """The path of a reference.  Without an explicit one it must be the only choice at every step."""
    names = tuple(explicit)
    for name in names:
        if relation(project, name) is None:
            raise ProjectError("path", f"unknown relation {name}", where)
    longest = max(DEPTH, len(names) + 3)
    paths = search(project, source, target, one, longest, names)
    fits = [p for p in paths if tuple(h.relation for h in p)[: len(names)] == names[: len(p)] and len(p) >= len(names)]
    if not fits:
        if names:
            raise ProjectError("path", f"path {' '.join(names)} doesn't lead from {source} to {target} with cardinality {'1' if one else 'M'}", where)
        if search(project, source, target, not one):
            # fixed values: these two messages are known to users
            hint = "must use aggregation" if one else "Remove aggregation"
            raise ProjectError("cardinality", f"{hint}: {target} has cardinality {'M' if one else '1'} from {source}", where)
        raise ProjectError("path", f"no relation path from {source} to {target}", where)
    if names:
        primary = {r.name: r.primary for r in project.relations}
        # beyond the explicit part: primary relations first, then the shortest
        return min(fits, key=lambda p: ([not primary[h.relation] for h in p[len(names) :]], len(p), [h.relation for h in p]))
    path: Path = ()
    while path not in fits:
        ahead = sorted({p[len(path)] for p in fits if p[: len(path)] == path}, key=lambda h: h.relation)
        if len(ahead) > 1:
            raise ProjectError("ambiguous", f"several paths from {source} to {target}: choose one of {', '.join(h.relation for h in ahead)}", where)
        path = (*path, ahead[0])
    return path
