"""Matches that are listed in their state's row, worked out for a batch of rows at once by NumPy.

Codes and their order are those of match.Codes. Work is done in slices of states that have about CANDIDATES
candidates, so that what is held doesn't grow with a batch or with how many matches its states have.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from braidwork.operators.match import Codes, signature_of

#: Candidates that are looked at together; a vertex that is null, and so equal to none; neighbouring states that are numbered by one task; most pairs of a state and a vertex that are counted together.
CANDIDATES, NULL, BLOCK, KEYS = 1 << 17, np.iinfo(np.int64).min, 1024, 1 << 18
ROOTS = StructType([StructField("root", LongType()), StructField("verts", ArrayType(ArrayType(LongType())))])


@dataclass(frozen=True)
class Blocks:
    """Roots that are made in Python, so that they can be listed as they are made.

    rows: all that make the roots of a block (see BLOCK) are in one partition, and in order there; made: batches of ROOTS from those of rows, in order of root.
    """

    rows: DataFrame
    made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

    @property
    def frame(self) -> DataFrame:
        return self.rows.mapInArrow(self.made, ROOTS)


def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Roots with _block."""
    for batch in batches:
        root = batch.column(0).fill_null(int(NULL)).to_numpy()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(root // BLOCK)], [*batch.schema.names, "_block"])


@dataclass
class Flat:
    """Edges of states, one state's after the other's: how many by state; arity and vertices (by place) by edge."""

    counts: np.ndarray
    arity: np.ndarray
    verts: list[np.ndarray]
    nulls: bool = False
    starts: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.starts = np.cumsum(self.counts) - self.counts

    def part(self, a: int, b: int) -> Flat:
        """States a to b."""
        lo = self.starts[a] if a < len(self.counts) else len(self.arity)
        hi = lo + self.counts[a:b].sum()
        return Flat(self.counts[a:b], self.arity[lo:hi], [v[lo:hi] for v in self.verts], self.nulls)

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a == b) & (a != NULL) if self.nulls else a == b

    def range(self) -> tuple[int, int]:
        """The least vertex, and how many numbers there are up to the highest; 0 if some are null."""
        if self.nulls or not len(self.arity) or not self.verts:
            return 0, 0
        low = min(int(v.min()) for v in self.verts)
        return low, max(int(v.max()) for v in self.verts) - low + 1

    def fitting(self, shape: tuple[int, ...]) -> np.ndarray:
        """Edges of an arity whose vertices repeat like a pattern edge's."""
        ok = self.arity == len(shape)
        for k, j in enumerate(shape):
            if j != k:
                ok &= self.equal(self.verts[k], self.verts[j])
        return np.flatnonzero(ok)


def flat_of(edges: pa.ListArray, arity: int) -> Flat:
    """From a column of states' edges, or of their vertices."""
    counts = edges.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    lists = edges.flatten()
    lists = lists.field("verts") if pa.types.is_struct(lists.type) else lists
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten()
    nulls = values.null_count > 0
    values = (values.fill_null(int(NULL)) if nulls else values).to_numpy(zero_copy_only=False)
    at = np.cumsum(n) - n
    verts = [values[np.where(n > k, at + k, 0)] if len(values) else np.zeros(len(n), np.int64) for k in range(arity)]
    return Flat(counts, n, verts, nulls)


def spread(counts: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of counts numbers that start at firsts: the run of each number, and the numbers."""
    run = np.repeat(np.arange(len(counts)), counts)
    return run, np.arange(len(run)) + np.repeat(firsts - (np.cumsum(counts) - counts), counts)


def slices(work: np.ndarray) -> Iterator[tuple[int, int]]:
    """Borders of runs of rows with about CANDIDATES work each, one row at least."""
    total, a = np.cumsum(work), 0
    while a < len(work):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CANDIDATES, "right")))
        yield a, b
        a = b


def found(codes: Codes, flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    """State and code of all matches, in order."""
    owner = np.repeat(np.arange(len(flat.counts)), flat.counts)
    place = np.arange(len(owner)) - flat.starts[owner]
    low, width = flat.range()
    width = width if len(flat.counts) * width <= KEYS else 0
    parts = []
    for number, rule in enumerate(codes.rules):
        taken: dict[int, np.ndarray] = {}  # edges by pattern position
        bound: dict[int, tuple[int, int]] = {}  # pattern position and place of a variable
        for p in rule.order:
            pattern = rule.lhs[p]
            fit = flat.fitting(signature_of(pattern))
            if not taken:
                taken[p] = fit
            else:
                key, wanted = owner[fit], owner[next(iter(taken.values()))]
                shared = [v for v in dict.fromkeys(pattern) if v in bound]
                if shared and width:  # edges are looked up by state and vertex
                    v, *shared = shared
                    q, k = bound[v]
                    key = key * width + (flat.verts[pattern.index(v)][fit] - low)
                    wanted = wanted * width + (flat.verts[k][taken[q]] - low)
                    fit = fit[np.argsort(key.astype(np.uint16) if len(flat.counts) * width <= 1 << 16 else key, kind="stable")]
                per = np.bincount(key, minlength=len(flat.counts) * (width or 1))
                run, at = spread(per[wanted], (np.cumsum(per) - per)[wanted])
                edge = fit[at]
                for v in shared:
                    q, k = bound[v]
                    keep = np.flatnonzero(flat.equal(flat.verts[pattern.index(v)][edge], flat.verts[k][taken[q]][run]))
                    run, edge = run[keep], edge[keep]
                for t in taken.values():
                    keep = np.flatnonzero(edge != t[run])
                    run, edge = run[keep], edge[keep]
                taken = {q: t[run] for q, t in taken.items()} | {p: edge}
            for k, v in enumerate(pattern):
                bound.setdefault(v, (p, k))
        code = np.full(len(taken[rule.order[0]]), number * codes.span, np.int64)
        for p, t in taken.items():
            code += place[t] << codes.shift(p)
        parts.append((owner[taken[rule.order[0]]], code))
    state, code = (np.concatenate(x) for x in zip(*parts, strict=True))
    if len(parts) > 1 or any(r.order != sorted(r.order) for r in codes.rules):
        order = np.lexsort((code, state))
        state, code = state[order], code[order]
    return state, code


def children(codes: Codes, flat: Flat, state: np.ndarray, code: np.ndarray, fresh: int) -> Flat:
    """Edges of the states that matches lead to; new vertices are numbered from `fresh`."""
    rule = code >> codes.bits * codes.places
    places = [(code >> codes.shift(p)) & ((1 << codes.bits) - 1) for p in range(codes.places)]
    used = np.array([len(r.lhs) for r in codes.rules])[rule]
    new = np.array([len(r.rhs) for r in codes.rules])[rule]
    held = flat.counts[state]
    run, edge = spread(held, flat.starts[state])
    place = edge - flat.starts[state][run]
    ok = np.ones(len(edge), bool)
    for p, at in enumerate(places):
        ok &= np.where(p < used, at, -1)[run] != place
    edge = edge[ok]
    left = held - used
    counts = left + new
    starts = np.cumsum(counts) - counts
    to = np.arange(len(edge)) + np.repeat(starts - (np.cumsum(left) - left), left)
    size = int(counts.sum())
    arity, verts = np.empty(size, np.int64), [np.zeros(size, np.int64) for _ in flat.verts]
    arity[to] = flat.arity[edge]
    for v, of in zip(verts, flat.verts, strict=True):
        v[to] = of[edge]
    for i, r in enumerate(codes.rules):
        mine = np.flatnonzero(rule == i)
        value: dict[int, np.ndarray | int] = {v: fresh + k for k, v in enumerate(r.new_variables)}
        for p, pattern in enumerate(r.lhs):
            at = flat.starts[state[mine]] + places[p][mine]
            for k, v in enumerate(pattern):
                if v not in value:
                    value[v] = flat.verts[k][at]
        for j, e in enumerate(r.rhs):
            at = starts[mine] + left[mine] + j
            arity[at] = len(e)
            for k, v in enumerate(e[: len(verts)]):
                verts[k][at] = value[v]
    return Flat(counts, arity, verts, flat.nulls)


def _lists(values: np.ndarray, counts: np.ndarray, type_: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, type_))


def listed(frontier: DataFrame | Blocks, codes: Codes, after: Codes | None, fresh: int | None) -> DataFrame:
    """frontier (with edges, or their verts), whose rows lie by _block and in order of state_id, or the roots of Blocks, with _codes (matches), _n and _k (how many, and their children's) and _n0 and _k0
    (of the states before in the block); with after also _kids (children's matches, one match's after the other's) and _kids_at (where each match's begin, and the end).

    fresh: a number above all vertices', or None. Where a state has more edges than codes can tell nothing is listed: whoever guesses their width must look at the sizes after.
    """
    rows, made = (frontier.rows, frontier.made) if isinstance(frontier, Blocks) else (frontier, None)
    fields = rows.schema.fields if made is None else [*ROOTS.fields, StructField("_block", LongType())]
    more = [StructField("_codes", ArrayType(IntegerType()))]
    if after is not None:
        more += [StructField("_kids", ArrayType(IntegerType())), StructField("_kids_at", ArrayType(IntegerType()))]
    names = [*(f.name for f in fields), *(f.name for f in more), "_n", "_k", "_n0", "_k0"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, [0, 0]

        def summed(block: np.ndarray, own: np.ndarray, which: int) -> np.ndarray:
            """Sums over the rows before in the block; the last block's go on with the next slice."""
            total = np.cumsum(own) - own
            first = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1])
            base = np.repeat(total[first], np.diff(np.concatenate([first, [len(block)]])))
            out = total - base + np.where((block == block[0]) & (block[0] == last), before[which], 0)
            before[which] = int(out[-1] + own[-1])
            return out

        for batch in batches if made is None else blocked(made(batches)):
            edges = flat_of(batch.column(batch.schema.get_field_index("edges" if "edges" in batch.schema.names else "verts")), max(c.arity for c in (codes, after or codes)))
            blocks = batch.column(batch.schema.get_field_index("_block")).to_numpy()
            above = fresh if fresh is not None else max((int(v.max()) + 1 for v in edges.verts if len(v)), default=0)
            lost = batch.column(0).is_null().to_numpy(zero_copy_only=False) if made is not None and batch.column(0).null_count else None
            for a, b in slices(edges.counts**codes.places * len(codes.rules)):
                flat = edges.part(a, b)
                state, code = found(codes, flat) if flat.counts.max() <= codes.width else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                if lost is not None:  # a root without a number is in no match
                    state, code = state[~lost[a:b][state]], code[~lost[a:b][state]]
                n = np.bincount(state, minlength=b - a)
                first = np.cumsum(n) - n
                for c, d in slices(n * (flat.counts + codes.grows) ** after.places * len(after.rules) if after else n):
                    lo = first[c]
                    hi = lo + n[c:d].sum()
                    columns = [*batch.slice(a + c, d - c).columns, _lists(code[lo:hi], n[c:d], pa.int32())]
                    kids = np.zeros(d - c, np.int64)
                    if after is not None:
                        child, theirs = found(after, children(codes, flat.part(c, d), state[lo:hi] - c, code[lo:hi], above))
                        per = np.bincount(child, minlength=hi - lo)
                        at = np.cumsum(per) - per
                        ends = np.concatenate([at, [len(child)]])
                        kids = ends[first[c:d] + n[c:d] - lo] - ends[first[c:d] - lo]
                        # A row's places are those of its matches and its end: one more than matches.
                        run, place = spread(n[c:d] + 1, first[c:d] - lo)
                        columns += [_lists(theirs, kids, pa.int32()), _lists(ends[place] - ends[first[c:d] - lo][run], n[c:d] + 1, pa.int32())]
                    block = blocks[a + c : a + d]
                    sums = [summed(block, n[c:d], 0), summed(block, kids, 1)]
                    last = block[-1]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in (n[c:d], kids, *sums))], names)

    schema = StructType([*fields, *more, *(StructField(x, LongType()) for x in ("_n", "_k", "_n0", "_k0"))])
    return rows.mapInArrow(run, schema)


def made_edges(codes: Codes, flat: Flat, state: np.ndarray, code: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Vertices, by place, of the edges that matches of rules without new variables make; one list for each edge of a rule's right side."""
    rule = code >> codes.bits * codes.places
    for i, r in enumerate(codes.rules):
        mine = np.flatnonzero(rule == i) if len(codes.rules) > 1 else slice(None)
        at = [flat.starts[state[mine]] + ((code[mine] >> codes.shift(p)) & ((1 << codes.bits) - 1)) for p in range(len(r.lhs))]
        where = {v: (p, k) for p, pattern in enumerate(r.lhs) for k, v in enumerate(pattern)}
        for e in r.rhs:
            yield [flat.verts[where[v][1]][at[where[v][0]]] for v in e]


def tallied(verts: list[np.ndarray]) -> Iterator[tuple[tuple[int, ...], int]]:
    """Different rows of the columns verts, and how many there are of each."""
    if not len(verts[0]):
        return
    lows = [int(v.min()) for v in verts]
    widths = [int(v.max()) - low + 1 for v, low in zip(verts, lows, strict=True)]
    if math.prod(widths) <= KEYS:
        key = np.ravel_multi_index([v - low for v, low in zip(verts, lows, strict=True)], widths)
        n = np.bincount(key)
        keys = np.flatnonzero(n)
        found_ = np.stack(np.unravel_index(keys, widths), 1) + np.array(lows)
        n = n[keys]
    else:
        found_, n = np.unique(np.stack(verts, 1), axis=0, return_counts=True)
    yield from zip(map(tuple, found_.tolist()), n.tolist(), strict=True)


def edge_counts(rows: DataFrame, codes: Codes, after: Codes | None) -> DataFrame:
    """verts, n: how many edges of roots, and of those that their matches (with after: and their children's) make, have these vertices.

    rows: verts, _codes, with after _kids and _kids_at, see listed. No rule has new variables. Vertices may come several times: what a task has counted
    it sends on when it has KEYS of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, ...], int] = {}

        def out() -> pa.RecordBatch:
            verts = pa.array([[None if v == NULL else v for v in k] for k in counts], pa.list_(pa.int64()))
            n = pa.array(list(counts.values()), pa.int64())
            counts.clear()
            return pa.RecordBatch.from_arrays([verts, n], ["verts", "n"])

        def add(verts: list[np.ndarray]) -> None:
            for k, n in tallied(verts) if verts else ():
                counts[k] = counts.get(k, 0) + n

        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            lengths = column["verts"].flatten().value_lengths().to_numpy(zero_copy_only=False)
            edges = flat_of(column["verts"], max(codes.arity, int(lengths.max()) if len(lengths) else 0))
            for k in np.unique(edges.arity).tolist():
                if k:
                    add([v[edges.arity == k] for v in edges.verts[:k]])
                else:
                    counts[()] = counts.get((), 0) + int((edges.arity == 0).sum())
            n = column["_codes"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            first, code = np.cumsum(n) - n, column["_codes"].flatten().to_numpy().astype(np.int64)
            kids = column["_kids"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if after else 0 * n
            for a, b in slices(n * (1 + (edges.counts + codes.grows if after else 0)) + kids):
                flat, lo = edges.part(a, b), first[a]
                own = code[lo : lo + n[a:b].sum()]
                state = np.repeat(np.arange(b - a), n[a:b])
                for verts in made_edges(codes, flat, state, own):
                    add(verts)
                if after:
                    at = column["_kids_at"].slice(a, b - a).flatten().to_numpy().astype(np.int64)
                    # Each row's places are those of its matches and its end.
                    last = np.cumsum(n[a:b] + 1) - 1
                    per = np.delete(np.diff(at), last[:-1]) if len(at) else at
                    theirs = column["_kids"].slice(a, b - a).flatten().to_numpy().astype(np.int64)
                    child = np.repeat(np.arange(len(own)), per)
                    for verts in made_edges(after, children(codes, flat, state, own, 0), child, theirs):
                        add(verts)
                if len(counts) >= KEYS:
                    yield out()
        if counts:
            yield out()

    names = ["verts", "_codes", *(["_kids", "_kids_at"] if after else [])]
    return rows.select(*names).mapInArrow(run, StructType([StructField("verts", ArrayType(LongType())), StructField("n", LongType())]))
