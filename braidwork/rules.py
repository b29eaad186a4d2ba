"""Rewrite rules: parsing, validation, join order and static analysis.

A rule is part of the plan, not data: its sides are tuples of variables, and the matcher and
rewriter compile them to column expressions.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence
from dataclasses import dataclass
from itertools import combinations

#: Limits of a rule (fixed values).
MAX_EDGES, MAX_ARITY, MAX_VARIABLES = 16, 16, 32

Side = tuple[tuple[int, ...], ...]


@dataclass(frozen=True)
class Rule:
    """lhs -> rhs over variables 0.., numbered by first appearance, left side first."""

    lhs: Side
    rhs: Side

    @property
    def lhs_variables(self) -> list[int]:
        return list(dict.fromkeys(v for e in self.lhs for v in e))

    @property
    def new_variables(self) -> list[int]:
        """Right-hand variables that the left side doesn't bind, ascending."""
        bound = set(self.lhs_variables)
        return sorted({v for e in self.rhs for v in e} - bound)

    @property
    def order(self) -> list[int]:
        """In which order the left side's edges are joined: the most constrained first, then whatever shares most variables with what is bound, of equals the most constrained."""
        if not self.lhs:
            return []

        def weight(i: int) -> int:
            own = self.lhs[i]
            repeats = sum(a == b for a, b in combinations(own, 2))
            linked = sum(bool(set(own) & set(e)) for j, e in enumerate(self.lhs) if j != i)
            return 100 * repeats + linked

        left = list(range(len(self.lhs)))
        out = [max(left, key=lambda i: (weight(i), -i))]
        left.remove(out[0])
        while left:
            bound = {v for i in out for v in self.lhs[i]}
            out.append(max(left, key=lambda i: (len(bound & set(self.lhs[i])), weight(i), -i)))
            left.remove(out[-1])
        return out

    # -- static analysis ---------------------------------------------------------------

    @property
    def connected(self) -> bool:
        """Whether shared variables link all edges of the left side."""
        if not self.lhs:
            return True
        seen, rest = set(self.lhs[0]), [set(e) for e in self.lhs[1:]]
        while near := [e for e in rest if e & seen]:
            seen = seen.union(*near)
            rest = [e for e in rest if not e & seen]
        return not rest

    @property
    def acyclic(self) -> bool:
        """Whether the left side reduces to nothing by removing ears."""
        edges = [set(e) for e in self.lhs]
        changed = True
        while changed and edges:
            changed = False
            for e in edges:
                lone = {v for v in e if sum(v in f for f in edges) == 1}
                if lone:
                    e -= lone
                    changed = True
            for i, e in enumerate(edges):
                if not e or any(e <= f for j, f in enumerate(edges) if j != i):
                    del edges[i]
                    changed = True
                    break
        return not edges

    @property
    def edge_cover(self) -> int:
        """The fewest left-hand edges that hold all its variables: matches are bounded by (edges ** cover)."""
        want = set(self.lhs_variables)
        return next(n for n in range(len(self.lhs) + 1) if any(set().union(*map(set, c)) >= want for c in combinations(self.lhs, n)))

    def analysis(self) -> dict:
        """What can be told of a rule before it runs."""
        delta = len(self.rhs) - len(self.lhs)
        return {
            "edge_delta": delta,
            "new_vertices": len(self.new_variables),
            "lhs_arities": sorted({len(e) for e in self.lhs}),
            "rhs_arities": sorted({len(e) for e in self.rhs}),
            "non_growing": delta <= 0,
            "bounded_vertices": not self.new_variables,
            "connected": self.connected,
            "acyclic": self.acyclic,
            "cyclic_multiedge": len(self.lhs) >= 3 and not self.acyclic,
            "edge_cover": self.edge_cover,
            "forwarding_pays": len(self.lhs) > 1,
        }


def _side(edges: Iterable[Sequence[Hashable]], name: str) -> list[tuple[Hashable, ...]]:
    out = [tuple(e) for e in edges]
    if len(out) > MAX_EDGES:
        raise ValueError(f"{name} has more than {MAX_EDGES} edges")
    if any(not 1 <= len(e) <= MAX_ARITY for e in out):
        raise ValueError(f"{name}: edges must have 1 to {MAX_ARITY} vertices")
    if any(isinstance(v, int) and v < 0 for e in out for v in e):
        raise ValueError(f"{name}: a variable is negative")
    return out


def rule(lhs: Iterable[Sequence[Hashable]], rhs: Iterable[Sequence[Hashable]]) -> Rule:
    """A rule from symbols of any kind. An empty left side is an error, an empty right side is legal."""
    left, right = _side(lhs, "the left side"), _side(rhs, "the right side")
    if not left:
        raise ValueError("the left side is empty")
    number: dict[Hashable, int] = {}
    numbered = [tuple(tuple(number.setdefault(v, len(number)) for v in e) for e in s) for s in (left, right)]
    if len(number) > MAX_VARIABLES:
        raise ValueError(f"a rule has more than {MAX_VARIABLES} variables")
    return Rule(*numbered)


def rules(items: object) -> list[Rule]:
    """One rule, a pair (lhs, rhs), or a list of either."""
    if isinstance(items, Rule):
        return [items]
    if isinstance(items, tuple) and len(items) == 2 and not isinstance(items[0], Rule):
        return [rule(*items)]
    return [x if isinstance(x, Rule) else rule(*x) for x in items]


def can_branch(found: Sequence[Rule]) -> bool:
    """False if no two events of a state can ever share an edge: single-edge left sides of different arities."""
    arities = [len(r.lhs[0]) for r in found]
    return any(len(r.lhs) > 1 for r in found) or len(set(arities)) < len(arities)


def warnings(found: Sequence[Rule]) -> list[dict]:
    out = []
    for i, r in enumerate(found):
        if not r.connected:
            out.append({"kind": "DisconnectedLHS", "count": 1, "context": f"rule {i} matches every pair of its parts"})
        if len(r.lhs) >= 3 and not r.acyclic:
            out.append({"kind": "CyclicLHS", "count": 1, "context": f"rule {i} is joined edge by edge, which isn't worst-case optimal"})
    return out
