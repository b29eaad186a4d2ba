"""Column functions on edges: arrays of vertices, and arrays of structs with verts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An edge of a state: its id, ordered vertices, the event that made it (null: initial) and that event's depth.
EDGE = "struct<edge_id:bigint,verts:array<bigint>,creator:bigint,cdepth:int>"


def signature(verts: Column) -> Column:
    """Repetition pattern of an edge: (a, b, a) gives (0, 1, 0)."""
    return F.transform(verts, lambda v: (F.array_position(F.array_distinct(verts), v) - 1).cast("int"))


def distinct_vertices(verts: Column) -> Column:
    return F.size(F.array_distinct(verts))


def compatible(verts: Column, pattern: list[int]) -> Column:
    """Whether an edge can match a pattern edge by itself: equal arity, and equal vertices where the pattern repeats."""
    out = F.size(verts) == len(pattern)
    for i, v in enumerate(pattern):
        if (j := pattern.index(v)) != i:
            out = out & (F.get(verts, F.lit(j)) == F.get(verts, F.lit(i)))
    return out


def contents(edges: Column) -> Column:
    """Ordered content of a state: its edges' vertices in order of their ids."""
    return F.transform(edges, lambda e: e["verts"])


def renumbered(edges: Column) -> Column:
    """Edges (arrays of vertices) with vertices numbered 0.. in order of first appearance."""
    names = F.array_distinct(F.flatten(edges))
    return F.transform(edges, lambda e: F.transform(e, lambda v: F.array_position(names, v) - 1))


def text(edges: Column) -> Column:
    """Edges (arrays of vertices) as text: vertices parted by commas, edges by semicolons."""
    return F.array_join(F.transform(edges, lambda e: F.array_join(F.transform(e, lambda v: v.cast("string")), ",")), ";")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once a row, even where body uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def colours(edges: Column, rounds: int) -> Column:
    """By vertex, in order of first appearance: its colour after some rounds of refinement of edges (arrays of vertices).

    Colour 0 is where a vertex stands, as arity:place; each round takes the digest of a vertex's colour and, by place, the colours in its edges.
    """

    def by_vertex(e: Column, names: Column, of: Column, say: Callable[[Column, Column, Column], Column]) -> Column:
        """For each vertex the sorted words that say(edge, its part of `of`, place) gives where it stands."""

        def words(v: Column) -> Column:
            at = F.zip_with(e, of, lambda one, x: F.transform(F.filter(F.sequence(F.lit(0), F.size(one) - 1), lambda k: F.get(one, k) == v), lambda k: say(one, x, k)))
            return F.array_join(F.array_sort(F.flatten(at)), " ")

        return F.transform(names, words)

    def again(e: Column, names: Column, last: Column) -> Column:
        seen = F.transform(e, lambda one: F.array_join(F.transform(one, lambda v: F.get(last, (F.array_position(names, v) - 1).cast("int"))), "|"))
        around = bound(seen, lambda s: by_vertex(e, names, s, lambda _, x, k: F.concat_ws("@", k, x)))
        return F.zip_with(last, around, lambda a, b: F.md5(F.concat_ws("/", a, b)))

    def refine(e: Column, names: Column) -> Column:
        now = by_vertex(e, names, e, lambda one, _, k: F.concat_ws(":", F.size(one), k))
        for _ in range(rounds):
            now = bound(now, lambda last: again(e, names, last))
        return now

    return bound(edges, lambda e: bound(F.array_distinct(F.flatten(e)), lambda names: refine(e, names)))


def component_sets(edges: Column) -> Column:
    """Connected components of edges (arrays of vertices), as arrays of vertices; each edge merges the sets that it meets."""
    none = F.array().cast("array<array<bigint>>")

    def merge(sets: Column, edge: Column) -> Column:
        hit = F.filter(sets, lambda s: F.arrays_overlap(s, edge))
        rest = F.filter(sets, lambda s: ~F.arrays_overlap(s, edge))
        return F.concat(rest, F.array(F.array_distinct(F.concat(edge, F.flatten(hit)))))

    return F.aggregate(edges, none, merge)


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone: the first 52 bits of the MD5 digest of both as text, parted by slashes."""
    said = F.concat_ws("/", F.lit(str(seed)), *(k.cast("string") for k in key))
    return F.conv(F.substring(F.md5(said), 1, 13), 16, 10).cast("double") / float(1 << 52)
