"""Matching: all ordered assignments of distinct edges of a state to a rule's left-hand edges.

Two layouts. Nested: a state is a row with an array of edges; filters on the array stand
before each explode, so only edges that fit what is bound make rows, and nothing is shuffled.
Exploded: an edge is a row (state_id, edge_id, verts); edges are joined on the state and on the
variables they share, for few states with very many edges.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.functions import compatible
from braidwork.rules import Rule


def fits(rule: Rule, position: int, verts: Column, bound: dict[int, Column]) -> Column:
    """Arity, repeated variables and bound variables of one pattern edge."""
    pattern = rule.lhs[position]
    out = compatible(verts, list(pattern))
    for i, v in enumerate(pattern):
        if v in bound and pattern.index(v) == i:
            out = out & (F.get(verts, F.lit(i)) == bound[v])
    return out


def _bind(rule: Rule, position: int, verts: Column, bound: dict[int, Column]) -> None:
    for i, v in enumerate(rule.lhs[position]):
        bound.setdefault(v, F.get(verts, F.lit(i)))


def nested(states: DataFrame, rule: Rule, keep: list[str], delta: Callable[[int, Column], Column] | None = None) -> DataFrame:
    """keep, _e0.._ek (matched edges, by pattern position) and _binding (by variable) for all matches of a rule.

    states: the columns keep and edges. delta(position, edge) narrows what a pattern edge may match.
    """
    bound: dict[int, Column] = {}
    out, taken = states, []

    def candidates(p: int, e: Column) -> Column:
        good = fits(rule, p, e["verts"], bound)
        for t in taken:
            good = good & (e["edge_id"] != F.col(t)["edge_id"])
        return good & delta(p, e) if delta else good

    for p in rule.order:
        out = out.select("*", F.explode(F.filter("edges", lambda e: candidates(p, e))).alias(f"_e{p}"))  # noqa: B023
        taken.append(f"_e{p}")
        _bind(rule, p, F.col(f"_e{p}")["verts"], bound)
    binding = F.array(*(bound[v] for v in sorted(bound)))
    return out.select(*keep, *(f"_e{p}" for p in range(len(rule.lhs))), binding.alias("_binding"))


def signature_of(pattern: tuple[int, ...]) -> tuple[int, ...]:
    """Where each of a pattern edge's variables stands first."""
    return tuple(pattern.index(v) for v in pattern)


#: A state's edge at a place.
Edge = Callable[[Column], Column]


@dataclass(frozen=True)
class Codes:
    """Matches of some rules as whole numbers: the rule, then the places of the matched edges in the state's row by pattern position, `bits` for each.

    Where a row's edges are in order of their ids, codes are in the order of rule and matched edges. Rules have left sides, states at most `width` edges.
    See operators.listing for how they are found.
    """

    rules: list[Rule]
    width: int

    @property
    def places(self) -> int:
        return max(len(r.lhs) for r in self.rules)

    @property
    def bits(self) -> int:
        return max(1, (self.width - 1).bit_length())

    @property
    def span(self) -> int:
        """Codes of one rule."""
        return 1 << self.bits * self.places

    @property
    def arity(self) -> int:
        return max(len(e) for r in self.rules for e in r.lhs)

    def shift(self, position: int) -> int:
        return self.bits * (self.places - 1 - position)

    @property
    def grows(self) -> int:
        """Most edges that a match adds to a state."""
        return max(0, *(len(r.rhs) - len(r.lhs) for r in self.rules))

    def rule(self, code: Column) -> Column:
        return F.shiftright(code, self.bits * self.places) if len(self.rules) > 1 else F.lit(0)

    def place(self, code: Column, position: int) -> Column:
        return F.shiftright(code, self.shift(position)).bitwiseAND((1 << self.bits) - 1)

    def _by_rule(self, code: Column, of: Callable[[Rule], Column]) -> Column:
        out = of(self.rules[-1])
        for i, r in reversed(list(enumerate(self.rules[:-1]))):
            out = F.when(code < (i + 1) * self.span, of(r)).otherwise(out)
        return out

    def used(self, code: Column, edge: Edge, fields: tuple[str, ...] = ("edge_id", "creator", "cdepth")) -> Column:
        """The matched edges by pattern position; edge: the state's edge at a place."""
        return self._by_rule(code, lambda r: F.array(*(F.struct(*(edge(self.place(code, p))[c].alias(c) for c in fields)) for p in range(len(r.lhs)))))

    def places_of(self, code: Column) -> Column:
        """The places of the matched edges."""
        return self._by_rule(code, lambda r: F.array(*(self.place(code, p) for p in range(len(r.lhs)))))

    def _ranked(self, code: Column, r: Rule) -> list[Column]:
        at = [self.place(code, p) for p in range(len(r.lhs))]
        if len(at) == 2:
            return [F.least(*at), F.greatest(*at)]
        ranked = F.sort_array(F.array(*at))
        return at if len(at) < 2 else [F.get(ranked, F.lit(k)) for k in range(len(at))]

    def child(self, code: Column, edges: Column, made: Column) -> Edge:
        """An edge by its place in the state that a match leads to, without making that state; made: what the match makes."""

        def at(place: Column) -> Column:
            def of(r: Rule) -> Column:
                old = place
                for used in self._ranked(code, r):
                    old = old + (old >= used).cast("int")
                left = F.size(edges) - len(r.lhs)
                return F.when(place < left, F.get(edges, old)).otherwise(F.get(made, place - left))

            return self._by_rule(code, of)

        return at

    def left(self, code: Column, edges: Column) -> Column:
        """The edges that a match doesn't use, as slices between those that it does."""

        def of(r: Rule) -> Column:
            at = self._ranked(code, r)
            begins = [F.lit(1), *(a + 2 for a in at)]
            ends = [*at, F.size(edges)]
            return F.concat(*(F.slice(edges, b, e - b + 1) for b, e in zip(begins, ends, strict=True)))

        return self._by_rule(code, of)

    def consumed(self, code: Column, edge: Edge) -> Column:
        return self._by_rule(code, lambda r: F.array(*(edge(self.place(code, p))["edge_id"] for p in range(len(r.lhs)))))

    def binding(self, code: Column, edge: Edge) -> Column:
        """Vertices by variable; null after a rule's own variables."""
        most = max(len(r.lhs_variables) for r in self.rules)

        def of(r: Rule) -> Column:
            bound: dict[int, Column] = {}
            for p in r.order:
                _bind(r, p, edge(self.place(code, p))["verts"], bound)
            return F.array(*(bound[v] for v in sorted(bound)), *[F.lit(None).cast("long")] * (most - len(bound)))

        return self._by_rule(code, of)

    def shared(self, a: Column, b: Column) -> Column:
        """The first place that two matches have in common, or null."""

        def at(code: Column, p: int) -> Column:
            short = [i for i, r in enumerate(self.rules) if len(r.lhs) <= p]
            return F.when(~self.rule(code).isin(short), self.place(code, p)) if short else self.place(code, p)

        both = [F.when(at(a, p) == at(b, q), at(a, p)) for p in range(self.places) for q in range(self.places)]
        return both[0] if len(both) == 1 else F.least(*both)


def matches(states: DataFrame, rules: list[Rule], id_column: str = "state_id") -> DataFrame:
    """state_id, rule, matched (edge ids by pattern position), binding of all matches of all rules."""
    parts = []
    for i, r in enumerate(rules):
        m = nested(states.select(id_column, "edges"), r, [id_column])
        ids = F.array(*(F.col(f"_e{p}")["edge_id"] for p in range(len(r.lhs))))
        parts.append(m.select(id_column, F.lit(i).alias("rule"), ids.alias("matched"), F.col("_binding").alias("binding")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_matches(states: DataFrame, rules: list[Rule], most: int, id_column: str = "state_id") -> DataFrame:
    """No more than `most` matches, the first by state, rule and matched edges."""
    return matches(states, rules, id_column).orderBy(id_column, "rule", "matched").limit(most)


def exploded(edges: DataFrame, rule: Rule) -> DataFrame:
    """state_id and e0.. (edge ids by pattern position) over rows (state_id, edge_id, verts), by equi-joins."""
    out, bound, taken = None, {}, []
    for p in rule.order:
        side = edges.where(fits(rule, p, F.col("verts"), {})).select(F.col("state_id").alias(f"s{p}"), F.col("edge_id").alias(f"e{p}"), F.col("verts").alias(f"v{p}"))
        if out is None:
            out = side.withColumnRenamed(f"s{p}", "state_id")
        else:
            on = F.col("state_id") == F.col(f"s{p}")
            for i, v in enumerate(rule.lhs[p]):
                if v in bound and rule.lhs[p].index(v) == i:
                    on = on & (bound[v] == F.get(F.col(f"v{p}"), F.lit(i)))
            for t in taken:
                on = on & (F.col(t) != F.col(f"e{p}"))
            out = out.join(side, on).drop(f"s{p}")
        taken.append(f"e{p}")
        _bind(rule, p, F.col(f"v{p}"), bound)
    return out.select("state_id", *(f"e{p}" for p in range(len(rule.lhs))))


def delta_matches(states: DataFrame, rule: Rule, produced: str = "produced") -> DataFrame:
    """Matches with at least one produced edge. states also has an array of the produced edges' ids.

    One branch for each pattern position: it matches a produced edge there, and old ones at the
    positions before, so that no match comes twice.
    """
    parts = []
    for first in range(len(rule.lhs)):

        def new_there(p: int, e: Column, first: int = first) -> Column:
            new = F.array_contains(F.col(produced), e["edge_id"])
            return new if p == first else ~new if p < first else F.lit(True)

        m = nested(states, rule, ["state_id"], new_there)
        parts.append(m.select("state_id", F.array(*(F.col(f"_e{p}")["edge_id"] for p in range(len(rule.lhs)))).alias("matched")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def forwarded(parent_matches: DataFrame, children: DataFrame) -> DataFrame:
    """Matches of a parent that none of the consumed edges are part of, for each child.

    parent_matches: state_id, matched; children: state_id, parent_state, consumed.
    """
    m = parent_matches.select(F.col("state_id").alias("parent_state"), "matched")
    return children.join(m, "parent_state").where(~F.arrays_overlap("matched", "consumed")).select("state_id", "matched")
