"""Scanning rule texts: any Spark SQL expression with ``[Source].attribute`` in it.

Nothing of SQL is parsed but what the planner must know: quotes, references, aggregate calls and windows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from weft.errors import ProjectError
from weft.functions import aggregates

_WORD = re.compile(r"\w+")
_CALL = re.compile(r"(\w+)\s*\(")
_WINDOW = re.compile(r"\s*(?:within\s+group\s*\(|filter\s*\(|over\s*\(|over\s+\w)", re.I)


@dataclass(frozen=True)
class Ref:
    """``[source].attribute``; source is None for ``[This]``, and ``related`` marks ``[Related]`` of a relation."""

    source: str | None
    attribute: str
    related: bool = False


@dataclass
class Agg:
    """An aggregate call that is no window: its parts, from the name to the closing bracket."""

    name: str
    parts: list[str | Ref]

    def refs(self) -> list[Ref]:
        return [p for p in self.parts if isinstance(p, Ref)]


@dataclass
class Expression:
    text: str
    parts: list[str | Ref | Agg] = field(default_factory=list)
    windowed: bool = False

    def refs(self) -> list[Ref]:
        """References outside aggregates."""
        return [p for p in self.parts if isinstance(p, Ref)]

    def aggs(self) -> list[Agg]:
        return [p for p in self.parts if isinstance(p, Agg)]

    def render(self, of_ref, of_agg=None) -> str:
        return "".join(p if isinstance(p, str) else of_agg(p) if isinstance(p, Agg) else of_ref(p) for p in self.parts)


def _tokens(text: str, where: str) -> list[tuple[int, int, str | Ref]]:
    """(start, end, reference or quoted text) of everything that is not plain text."""
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        if c in "'\"`":
            j = i + 1
            while j < n and not (text[j] == c and text[j + 1 : j + 2] != c):
                j += 2 if text[j] == c or text[j] == "\\" and c != "`" else 1
            if j >= n:
                raise ProjectError("quote", f"quote at {i} is not closed", where)
            out.append((i, j + 1, text[i : j + 1]))
            i = j + 1
        elif text[i : i + 2] in ("/*", "--"):
            raise ProjectError("comment", "comments are not allowed", where)
        elif c == "[":
            j = i + 1
            while j < n and text[j] != "]":
                if text[j] == "[":
                    raise ProjectError("bracket", f"nested [ at {j}", where)
                j += 1
            name = text[i + 1 : j].strip()
            if j >= n:
                raise ProjectError("bracket", f"[ at {i} is not closed", where)
            if not name:
                raise ProjectError("bracket", f"empty [] at {i}", where)
            if name.isdigit():
                i = j + 1  # an array index
                continue
            m = _WORD.match(text, j + 2) if text[j + 1 : j + 2] == "." else None
            if m is None:
                raise ProjectError("bracket", f"expected .attribute after [{name}] at {j + 1}", where)
            low = name.lower()
            out.append((i, m.end(), Ref(None if low in ("this", "related") else name, m[0].lower(), low == "related")))
            i = m.end()
        else:
            i += 1
    return out


def _closing(text: str, opening: int, covered: list[bool], where: str) -> int:
    depth = 0
    for i in range(opening, len(text)):
        if not covered[i]:
            depth += (text[i] == "(") - (text[i] == ")")
            if not depth:
                return i
    raise ProjectError("bracket", f"( at {opening} is not closed", where)


def parse(text: str | None, where: str = "") -> Expression:
    """The expression with its references and aggregate calls; raises for what can't be a rule."""
    if text is None or not str(text).strip():
        raise ProjectError("empty", "expression is empty", where)
    text = str(text).strip()
    tokens = _tokens(text, where)
    covered = [False] * len(text)
    for a, z, _ in tokens:
        covered[a:z] = [True] * (z - a)
    calls: list[tuple[int, int, str]] = []
    windowed = False
    for m in _CALL.finditer(text):
        if covered[m.start()] or m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "_."):
            continue
        name = m[1].lower()
        if name == "over":
            windowed = True
        if name not in aggregates.NAMES:
            continue
        end = _closing(text, m.end() - 1, covered, where)
        over = end
        while w := _WINDOW.match(text, over + 1):
            if w[0].rstrip().lower().endswith("("):
                over = _closing(text, w.end() - 1, covered, where)
            else:
                over = w.end()
            if w[0].lower().lstrip().startswith("over"):
                windowed = True
                break
        else:
            if any(a < m.start() < z for a, z, _ in calls):
                raise ProjectError("nested aggregate", f"aggregate {name} within an aggregate", where)
            calls.append((m.start(), over + 1, name))
    if calls and windowed:
        raise ProjectError("window", "a rule can't have both a window and an aggregate", where)
    out = Expression(text, windowed=windowed)
    refs = [(a, z, t) for a, z, t in tokens if isinstance(t, Ref)]

    def pieces(lo: int, hi: int) -> list[str | Ref]:
        found, at = [], lo
        for a, z, r in refs:
            if lo <= a < hi:
                found += [text[at:a], r]
                at = z
        return [p for p in [*found, text[at:hi]] if p != ""]

    at = 0
    for a, z, name in calls:
        if name in aggregates.REJECTED:
            raise ProjectError("aggregate", f"{name} {aggregates.REJECTED[name]}", where)
        out.parts += pieces(at, a)
        out.parts.append(Agg(name, pieces(a, z)))
        at = z
    out.parts += pieces(at, len(text))
    return out
