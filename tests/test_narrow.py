"""Steps and results that shuffle nothing but the first states, against the ways that shuffle."""

import itertools

import numpy as np
import pytest

from braidwork import rules as R
from braidwork.operators import canonical, listing, match
from braidwork.plans import evolve as plans
from braidwork.plans import results
from braidwork.plans.evolve import Evolution, Options, evolve
from braidwork.plans.replay import replay
from braidwork.sources import generators, tables

RULES = [[[["y", "z"], ["x", "y"]], [["x", "z"], ["z", "w"]]], [[["x", "x"]], [["x"]]], [[["x"], ["x", "y"]], [["y"]]]]
STATES = [[[0, 1], [1, 2], [2, 2]], [[0, 1]], [[0, 0], [0], [0, 1]], [[0, 1], [1, 0], [0, 1]]]


def rows(df):
    return sorted(map(str, df.collect()))


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def told(e):
    columns = ["event_id", "rule", "step", "input_state", "output_state", "consumed", "produced", "causes"]
    return [rows(x) for x in (e.events.select(columns), e.states.select("state_id", "step", "edges", "hist"), e.branchial(), e.global_edges(), results.history(e), e.canonical_ids("Automatic"), e.canonical_events("Full", "Automatic"), e.frontier("Automatic"))]


@pytest.mark.parametrize("limits", [{}, {"max_events": 9}])
def test_listed_matches(spark, monkeypatch, limits):
    listed = evolve(spark, RULES, STATES, 3, **limits)
    assert all(listed.group_parts)
    found = told(listed)
    monkeypatch.setattr(plans, "LISTED", 0)
    joined = evolve(spark, RULES, STATES, 3, **limits)
    assert not any(joined.group_parts)
    assert found == told(joined)


def test_shuffles_nothing(spark):
    e = evolve(spark, RULES, STATES, 2)
    graphs = [e.graph(k) for k in ("StatesGraph", "CausalGraph", "BranchialGraph", "EvolutionCausalBranchialGraph")]
    for df in (e.events, e.states, e.branchial(), e.global_edges(), e.causal_edges(), e.canonical_ids("None"), results.history(e), results.events(e, "None", minimal=True), *graphs):
        assert shuffles(df) == 0
    assert shuffles(e.canonical_ids("Automatic")) == 1


def test_light_cone_of_copies(spark):
    points = [(i, float(i * 37 % 11), float(i * 53 % 7)) for i in range(300)]  # 77 places
    df = spark.createDataFrame([*points, (300, None, 1.0)], "id long, t double, x double")
    inside = lambda a, b: 0 < b[1] - a[1] and 0 < (b[1] - a[1]) ** 2 - (b[2] - a[2]) ** 2 <= 25
    pairs = {(a[0], b[0]) for a in points for b in points if inside(a, b)}
    cone = generators.light_cone(df, cutoff=5.0)
    assert sorted(map(tuple, cone.collect())) == sorted(pairs)
    assert "explode(_src" in cone._jdf.queryExecution().optimizedPlan().toString()  # places are linked, not events
    plain = generators.without_shortcuts(cone)
    assert rows(generators.light_cone(df, cutoff=5.0, reduce=True)) == rows(plain)


def test_replay_shuffles_nothing(spark):
    q = replay(Evolution(spark, R.rules(RULES), Options(), quotient=True).start(STATES).step(3))
    for df in (q.events, q.causal_pairs(), q.branchial()):
        assert shuffles(df) == 0
    found = q.events.orderBy("event_id").collect()
    assert [r.event_id for r in found] == list(range(len(found))) and q.num_events() == len(found)
    assert [r.input_state for r in found] == sorted(r.input_state for r in found)
    full = evolve(spark, RULES, STATES, 3)
    by = lambda e: rows(e.branchial(with_step=True).groupBy("step").count())
    assert by(q) == by(full)
    at = {r.event_id: r for r in found}
    for a, b, edge in map(tuple, q.branchial().collect()):
        assert a < b and at[a].input_state == at[b].input_state and edge == min(set(at[a].consumed) & set(at[b].consumed))


def test_forms_of_reordered_edges(spark):
    edges = [(0, 1), (1, 1), (1, 2), (2, 0), (0, 1)]
    canonical._component.cache_clear()
    forms = {canonical.canonical([edges[(i + k) % 5] for i in range(5)])[0] for k in range(5)}
    assert len(forms) == 1 and canonical._component.cache_info().misses < 5
    e = evolve(spark, RULES, STATES, 1)
    assert shuffles(canonical.with_form(e.states)) == shuffles(canonical.with_frame(e.states)) == 0


@pytest.mark.parametrize("family", ["F1", "F2", "FM"])
def test_states_shuffle_lines_once(spark, family):
    sf = "/root/testdata/sf0.001"
    states = tables.states(spark, sf, family)
    assert shuffles(states) == 1 and "Window" not in states._jdf.queryExecution().executedPlan().toString()
    assert rows(states.selectExpr("state_id", "inline(edges)").select("state_id", "edge_id", "verts")) == rows(tables.edges(spark, sf, family))


def test_listing(monkeypatch):
    found, rng = R.rules(RULES), np.random.default_rng(5)
    states = [[tuple(int(v) for v in rng.integers(0, 3, rng.integers(1, 3))) for _ in range(k)] for k in (3, 0, 5, 1, 4)]

    def brute(state, codes):
        out = []
        for i, r in enumerate(codes.rules):
            for at in itertools.permutations(range(len(state)), len(r.lhs)):
                bound = {}
                if all(len(state[a]) == len(e) and all(bound.setdefault(v, x) == x for v, x in zip(e, state[a])) for a, e in zip(at, r.lhs)):
                    rest = [e for k, e in enumerate(state) if k not in at]
                    fresh = {v: 9 + k for k, v in enumerate(r.new_variables)}
                    out.append((i * codes.span + sum(a << codes.shift(p) for p, a in enumerate(at)), rest + [tuple((bound | fresh)[v] for v in e) for e in r.rhs]))
        return sorted(out)

    def flat(states):
        edges = [e for s in states for e in s]
        return listing.Flat(np.array([len(s) for s in states]), np.array([len(e) for e in edges]), [np.array([(*e, 0, 0)[k] for e in edges]) for k in range(2)])

    codes = match.Codes(found, 8)
    expected = [brute(s, codes) for s in states]
    state, code = listing.found(codes, flat(states))
    assert list(zip(state, code)) == [(i, c) for i, s in enumerate(expected) for c, _ in s]
    kids = listing.children(codes, flat(states), state, code, 9)
    ends = np.cumsum(kids.counts)
    assert [[tuple(int(v[e]) for v in kids.verts)[: kids.arity[e]] for e in range(b - n, b)] for b, n in zip(ends, kids.counts)] == [k for s in expected for _, k in s]
    monkeypatch.setattr(listing, "CANDIDATES", 3)
    assert list(listing.slices(np.array([0, 1, 2, 9, 1, 1, 5]))) == [(0, 3), (3, 4), (4, 6), (6, 7)]


def test_cliques_and_vertices_shuffle_nothing(spark):
    e = evolve(spark, RULES, STATES, 2)
    cliques = e.clique_sizes()
    assert shuffles(cliques) == 0 and shuffles(e.graph_vertices("EvolutionGraph")) == 0
    plain = e.consumed.groupBy("input_state", "edge_id").count().groupBy("input_state").agg({"*": "count", "count": "max"}).select("input_state", "`count(1)`", "`max(count)`")
    assert rows(cliques.toDF("input_state", "count(1)", "max(count)")) == rows(plain)


def test_steered_step_lists_one_depth(spark):
    e = Evolution(spark, R.rules(RULES)).start(STATES).step()
    e.step(only=e.frontier().where("state_id % 2 = 0"))
    assert not e.ahead and all(e.group_parts)
    whole = evolve(spark, RULES, STATES, 2)
    ends = lambda x: rows(x.events.where("step = 2 AND input_state % 2 = 0").select("input_state", "rule", "consumed"))
    assert ends(e) == ends(whole)


def made_in_blocks(spark):
    states = [(i, [list(e) for e in s]) for i, s in enumerate(STATES)]
    return listing.Blocks(spark.createDataFrame(states, listing.ROOTS).coalesce(1).sortWithinPartitions("root"), lambda batches: batches)


@pytest.mark.parametrize(("guessed", "limits"), [(plans.GUESSED, {}), (plans.GUESSED, {"max_events": 9}), (1, {})])  # 1: too narrow for some states
def test_roots_listed_as_made(spark, monkeypatch, guessed, limits):
    monkeypatch.setattr(plans, "GUESSED", guessed)
    e, plain = evolve(spark, RULES, made_in_blocks(spark), 2, **limits), evolve(spark, RULES, STATES, 2, **limits)
    assert bool(e.guess) == (guessed > 1)
    assert rows(e.events) == rows(plain.events) and rows(e.branchial()) == rows(plain.branchial())


def test_two_steps_write_roots_once(spark, monkeypatch):
    written, write = [], plans.checkpointed
    monkeypatch.setattr(plans, "checkpointed", lambda df: (written.append(df), write(df))[1])
    path2 = [[["x", "y"], ["y", "z"]], [["x", "z"]]]
    e = evolve(spark, [path2], tables.root_blocks(spark, "/root/testdata/sf0.001"), 2)
    assert len(written) == 2 and sum(map(shuffles, written)) == 2  # lines by block, sums by block
    plain = evolve(spark, [path2], tables.roots(spark, "/root/testdata/sf0.001"), 2)
    assert rows(e.events) == rows(plain.events) and rows(e.branchial()) == rows(plain.branchial())


def test_found_by_vertex(monkeypatch):
    rng = np.random.default_rng(7)
    counts = rng.integers(0, 7, 40)
    codes = match.Codes(R.rules([[[["x", "y"], ["y", "z"], ["z", "x"]], []], [[["x", "x"], ["x", "y"]], []], [[["x", "y"], ["x", "y"]], []]]), 8)
    flat = listing.Flat(counts, np.full(counts.sum(), 2), [rng.integers(-3, 3, counts.sum()) for _ in range(2)])
    by_vertex = listing.found(codes, flat)
    monkeypatch.setattr(listing, "KEYS", 0)
    assert len(by_vertex[1]) and all(map(np.array_equal, by_vertex, listing.found(codes, flat)))


@pytest.mark.parametrize(("steps", "keys"), [(2, listing.KEYS), (3, 2)])
def test_edge_counts(spark, monkeypatch, steps, keys):
    monkeypatch.setattr(listing, "KEYS", keys)
    own = [*RULES[1:], [[["x", "y"], ["y", "z"]], [["x", "z"], ["z"], ["y", "y", "x"]]]]
    e = evolve(spark, own, made_in_blocks(spark), steps)
    assert e.tallied == 2
    assert rows(e.edge_counts()) == rows(evolve(spark, own, STATES, steps).global_edges().groupBy("verts").count().toDF("verts", "edges"))
