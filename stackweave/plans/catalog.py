"""The type registry: node types, their children, composition, and templates of them."""

from __future__ import annotations

from dataclasses import dataclass, field

# How many children of a kind a node may have.
CARDINALITIES = {"ExactlyOne": (1, 1), "ZeroOrOne": (0, 1), "ZeroOrMore": (0, None), "OneOrMore": (1, None)}


class Conflict(ValueError):
    """Two definitions that cannot both hold."""


@dataclass(frozen=True)
class Child:
    name: str
    kind: str
    cardinality: str = "ExactlyOne"


@dataclass
class NodeType:
    name: str
    children: list[Child] = field(default_factory=list)
    includes: list[str] = field(default_factory=list)


class Registry:
    """Types by name; a type holds its own children and those of the types that it includes."""

    def __init__(self) -> None:
        self.types: dict[str, NodeType] = {}

    def register(self, t: NodeType) -> None:
        if t.name in self.types and self.types[t.name] != t:
            raise Conflict(f"{t.name} is defined otherwise")
        for c in t.children:
            if c.cardinality not in CARDINALITIES:
                raise Conflict(f"unknown cardinality {c.cardinality}")
        self.types[t.name] = t

    def children(self, name: str, path: tuple[str, ...] = ()) -> list[Child]:
        """All children of a type, included ones first; identical repeats count once, others conflict."""
        if name in path:
            raise Conflict(f"{name} includes itself")
        if name not in self.types:
            raise Conflict(f"no type {name}")
        t, out = self.types[name], {}
        for c in [*(c for i in t.includes for c in self.children(i, (*path, name))), *t.children]:
            if out.setdefault(c.name, c) != c:
                raise Conflict(f"{name} has two children {c.name}")
        return list(out.values())

    def definitions(self) -> list[tuple[str, str, int, int | None]]:
        """(parent_kind, kind, least, most) rows for the cardinality check."""
        return [(n, c.kind, *CARDINALITIES[c.cardinality]) for n in sorted(self.types) for c in self.children(n)]

    def export(self) -> list[tuple[str, str, str, str]]:
        return [(n, c.name, c.kind, c.cardinality) for n in sorted(self.types) for c in self.children(n)]


def compose(first: list[NodeType], second: list[NodeType], mode: str = "orthogonal") -> list[NodeType]:
    """Two templates as one: orthogonal ones must agree where they meet, in a merge the later wins."""
    out = {t.name: t for t in first}
    for t in second:
        if mode == "orthogonal" and t.name in out and out[t.name] != t:
            raise Conflict(f"{t.name} differs")
        out[t.name] = t
    return [out[n] for n in sorted(out)]


def version_key(version: str) -> tuple:
    """Orders versions ``1.2.3-rc1+build``: a release comes after its pre-releases, builds do not count."""
    core, _, pre = version.lstrip("v").partition("+")[0].partition("-")
    numbers = tuple(int(x) for x in core.split("."))
    if len(numbers) != 3:
        raise ValueError(f"not a version: {version}")
    parts = tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in pre.split(".")) if pre else ()
    return (*numbers, not pre, parts)
