"""Published counts of known evolutions, and properties that must hold."""

import random

import pytest

from braidwork import rules as R
from braidwork.operators import canonical, match, relations
from braidwork.plans.evolve import GRAPHS, Evolution, Options, evolve, initial_states, roots_of
from braidwork.streaming import Session, match_stream, merged

# Case, rules, initial state, steps; states by mode None, Automatic, Full; events None, Full, Automatic; causal triples, pairs; branchial pairs.
CORPUS = [
    ("binary-growth", [([(0, 1)], [(0, 2), (1, 2)])], [[0, 1]], 3, (10, 10, 6), (9, 5, 6), (8, 8), 0),
    ("2to4", [([(0, 1), (0, 2)], [(0, 1), (0, 3), (1, 3), (2, 3)])], [[0, 1], [0, 2]], 2, (7, 7, 4), (6, 3, 4), (8, 4), 3),
    ("triangle", [([(0, 1), (1, 2)], [(0, 2), (2, 3), (3, 0)])], [[0, 1], [1, 2]], 2, (5, 5, 3), (4, 2, 4), (6, 3), 3),
    ("reductive", [([(0, 1), (1, 2)], [(0, 2)])], [[0, 1], [1, 2], [2, 3], [3, 4]], 3, (16, 9, 4), (15, 3, 6), (12, 12), 5),
    ("idempotent", [([(0, 1), (1, 2)], [(0, 2), (2, 1)])], [[0, 1], [1, 2]], 3, (4, 2, 1), (3, 1, 1), (4, 2), 0),
    ("self-loop", [([(0, 0)], [(0, 1), (1, 0)])], [[0, 0]], 3, (2, 2, 2), (1, 1, 1), (0, 0), 0),
    ("mixed-arity", [([(0, 1)], [(0, 1, 2), (2, 0)])], [[0, 1]], 3, (4, 4, 4), (3, 3, 3), (2, 2), 0),
    ("arity3", [([(0, 1, 2)], [(0, 1, 3), (1, 2, 3)])], [[0, 1, 2]], 3, (10, 10, 9), (9, 9, 9), (8, 8), 0),
    ("disconnected", [([(0, 1), (2, 3)], [(0, 2), (1, 3)])], [[0, 1], [2, 3]], 3, (15, 8, 1), (14, 1, 2), (24, 12), 7),
    ("arity4", [([(0, 1, 2, 3)], [(0, 1, 2, 4), (1, 2, 3, 4)])], [[0, 1, 2, 3]], 3, (10, 10, 9), (9, 9, 9), (8, 8), 0),
    ("mixed-lhs", [([(0, 1), (0, 1, 2)], [(0, 2), (1, 2, 3)])], [[0, 1], [0, 1, 2]], 3, (2, 2, 2), (1, 1, 1), (0, 0), 0),
    ("mixed-init", [([(0, 1)], [(0, 1, 2)])], [[0, 1], [1, 2, 3], [2, 3]], 3, (5, 5, 4), (4, 4, 4), (0, 0), 0),
    ("arity3-to-2", [([(0, 1, 2)], [(0, 1), (1, 2)])], [[0, 1, 2], [1, 2, 3]], 3, (5, 5, 4), (4, 4, 4), (0, 0), 0),
    ("arity1", [([(0,), (0, 1)], [(1,), (0, 1), (0, 2)])], [[0], [0, 1]], 3, (2, 2, 2), (1, 1, 1), (0, 0), 0),
    ("cycle4", [([(0, 1), (1, 2)], [(0, 1), (1, 3), (3, 2)])], [[0, 1], [1, 2], [2, 3], [3, 0]], 3, (145, 145, 4), (144, 3, 15), (216, 152), 144),
    ("star4", [([(0, 1)], [(0, 1), (1, 2)])], [[0, 1], [0, 2], [0, 3], [0, 4]], 2, (25, 25, 5), (24, 4, 9), (8, 8), 0),
    ("multi-rule", [([(0, 1)], [(0, 2), (1, 2)]), ([(0, 1), (1, 2)], [(0, 2)])], [[0, 1], [1, 2]], 2, (12, 12, 10), (11, 11, 11), (6, 6), 4),
]
# Rules, initial state, by step: states, events, Full events, reduced causal pairs, branchial pairs.
STEPS = [
    ([([(1, 2)], [(1, 2), (2, 3)])], [[1, 2]], [(2, 1, 1, 0, 0), (4, 3, 3, 2, 0), (8, 9, 8, 8, 0)]),
    ([([(1, 2), (2, 3)], [(1, 2), (2, 3), (2, 4)])], [[1, 2], [2, 3], [3, 1]], [(2, 3, 1, 0, 3), (4, 15, 3, 12, 18), (8, 75, 9, 72, 108)]),
    ([([(1, 2), (2, 3)], [(1, 2), (2, 3), (2, 4)])], [[1, 1], [1, 1]], [(2, 2, 1, 0, 1), (3, 10, 2, 8, 13), (4, 58, 3, 56, 117)]),
    ([([(1, 2), (2, 3)], [(4, 1), (1, 4), (2, 3), (4, 3)])], [[1, 1], [1, 1]], [(2, 2, 1, 0, 1), (6, 16, 5, 14, 35), (33, 172, 36, 170, 489)]),
    ([([(1, 2, 3), (5, 1)], [(1, 5, 6), (3, 2), (3, 5)])], [[0, 0, 0], [0, 0]], [(2, 1, 1, 0, 0), (3, 3, 2, 2, 1), (5, 9, 4, 8, 7), (9, 29, 8, 28, 31)]),
]


@pytest.mark.parametrize("case", CORPUS, ids=[c[0] for c in CORPUS])
def test_corpus(spark, case):
    _, rules, init, steps, states, events, causal, branchial = case
    e = evolve(spark, rules, init, steps)
    assert tuple(e.num_states(m) for m in ("None", "Automatic", "Full")) == states
    assert tuple(e.num_events(m) for m in ("None", "Full", "Automatic")) == events
    triples = e.causal(reduce=False)
    assert (triples.count(), relations.causal_pairs(triples).count()) == causal
    assert e.branchial().count() == branchial


@pytest.mark.parametrize("case", range(len(STEPS)))
def test_steps(spark, case):
    rules, init, rows = STEPS[case]
    e = Evolution(spark, R.rules(rules)).start(init)
    for want in rows:
        e.step()
        pairs = relations.causal_pairs(e.causal())
        assert (e.num_states("Full"), e.num_events("None"), e.num_events("Full"), pairs.count(), e.branchial().count()) == want
    every = relations.causal_pairs(e.causal(reduce=False)).selectExpr("producer AS src", "consumer AS dst")
    assert sorted(map(tuple, relations.reduced(every).collect())) == sorted(map(tuple, pairs.collect()))


# Rules, initial state, steps, Automatic events.
@pytest.mark.parametrize(
    ("rules", "init", "steps", "want"),
    [
        ([([(0, 1), (1, 2)], [(0, 1), (1, 3), (3, 2), (2, 0)])], [[0, 1], [1, 2]], 4, 86),
        ([([(0, 1), (0, 2)], [(0, 1), (0, 3), (1, 3), (2, 3)])], [[0, 1], [0, 2]], 4, 52),
        ([([(0, 1)], [(0, 2), (2, 1)])], [[0, 1]], 4, 10),
        ([([(0, 1)], [(0, 2), (2, 1)]), ([(0, 1)], [(1, 2), (2, 0)])], [[0, 1]], 3, 21),
    ],
)
def test_quotient_equals_full(spark, rules, init, steps, want):
    q = Evolution(spark, R.rules(rules), Options(), quotient=True).start(init).step(steps)
    assert q.num_events("Automatic") == want  # one representative of each class is expanded
    full = evolve(spark, rules, init, min(steps, 3))
    if steps <= 3:
        assert full.num_events("Automatic") == want
        assert full.num_states("Full") == q.class_rows.count()
    by = {r.depth: r.states for r in q.raw_counts().collect()}
    assert [by[d] for d in range(min(steps, 3) + 1)] == [full.states.where(f"step = {d}").count() for d in range(min(steps, 3) + 1)]


def test_rules():
    r = R.rule([("x", "y"), ("y", "y")], [("y", "n")])
    assert r.lhs == ((0, 1), (1, 1)) and r.rhs == ((1, 2),) and r.new_variables == [2] and r.order == [1, 0]
    for bad in ([], [()], [tuple(range(17))], [(0, 1)] * 17, [(-1, 0)]):
        with pytest.raises(ValueError):
            R.rule(bad, [])
    with pytest.raises(ValueError):
        R.rule([tuple(range(k, k + 11)) for k in (0, 11, 22)], [])
    triangle, path = R.rule([(0, 1), (1, 2), (2, 0)], []), R.rule([(0, 1), (1, 2), (2, 3)], [])
    assert not triangle.acyclic and path.acyclic and path.edge_cover == 2 and triangle.edge_cover == 2
    assert not R.rule([(0, 1), (2, 3)], []).connected
    assert [w["kind"] for w in R.warnings([triangle, R.rule([(0, 1), (2, 3)], [])])] == ["CyclicLHS", "DisconnectedLHS"]
    assert not R.can_branch(R.rules([([(0, 1)], []), ([(0,)], [])])) and R.can_branch(R.rules([([(0, 1)], []), ([(1, 0)], [])]))
    assert path.analysis()["edge_delta"] == -3


def brute(edges, lhs):
    out = []

    def go(k, used, bound):
        if k == len(lhs):
            out.append(tuple(used))
            return
        for i, e in enumerate(edges):
            if i not in used and len(e) == len(lhs[k]):
                b = dict(bound)
                if all(b.setdefault(v, x) == x for v, x in zip(lhs[k], e)):
                    go(k + 1, [*used, i], b)

    go(0, [], {})
    return sorted(out)


def test_matching_layouts(spark):
    rng = random.Random(2)
    states = [[[rng.randrange(4) for _ in range(rng.choice((1, 2, 2, 3)))] for _ in range(7)] for _ in range(12)]
    rows = roots_of(initial_states(spark, states, renumber=False))
    width = 7
    for lhs in ([(0, 1), (1, 2)], [(0, 0)], [(0, 1), (2, 3)], [(0, 1, 0), (1, 2)], [(0,), (0, 1), (1, 2)]):
        r = R.rule(lhs, [])
        want = {i: brute(s, lhs) for i, s in enumerate(states)}
        got = match.matches(rows, [r]).collect()
        assert all(sorted(tuple(e - i * width for e in m.matched) for m in got if m.state_id == i) == w for i, w in want.items())
        edges = rows.selectExpr("state_id", "explode(edges) AS e").selectExpr("state_id", "e.edge_id AS edge_id", "e.verts AS verts")
        flat = match.exploded(edges, r).collect()
        assert all(sorted(tuple(e - i * width for e in tuple(m)[1:]) for m in flat if m.state_id == i) == w for i, w in want.items())
        new = rows.selectExpr("*", "transform(slice(edges, 6, 2), e -> e.edge_id) AS produced")
        some = match.delta_matches(new, r).collect()
        assert all(sorted(tuple(e - i * width for e in m.matched) for m in some if m.state_id == i) == [x for x in w if max(x) >= 5] for i, w in want.items())
    assert match_stream(rows, ([(0, 0)], [])).columns == ["state_id", "rule", "matched", "binding"]


def test_canonical_forms():
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randint(1, 6)
        edges = [tuple(rng.randrange(n) for _ in range(rng.choice((1, 2, 2, 3)))) for _ in range(rng.randint(1, 7))]
        name = list(range(10, 10 + n))
        rng.shuffle(name)
        other = [tuple(name[v] for v in e) for e in edges]
        rng.shuffle(other)
        assert canonical.isomorphic(edges, other)
        turned = [tuple(reversed(e)) if i == 0 else e for i, e in enumerate(edges)]
        from itertools import permutations

        names = sorted({v for e in edges for v in e})
        least = lambda es: min(sorted(tuple(p[names.index(v)] for v in e) for e in es) for p in permutations(range(len(names))))
        assert canonical.isomorphic(edges, turned) == (least(edges) == least(turned))
    six, two = [(i, (i + 1) % 6) for i in range(6)], [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3)]
    assert not canonical.isomorphic(six, two)
    assert len(set(canonical.canonical(six)[3])) == 1 and len(set(canonical.canonical([(0, 1), (1, 2)])[3])) == 2
    assert canonical.slots([0, 0, 2], [7, 5, 1]) == [1, 0, 2]
    assert canonical.canonical([])[0] == ()


def test_limits_and_sampling(spark):
    grow, init = ([(0, 1)], [(0, 1), (1, 2)]), [[0, 1], [0, 2], [0, 3]]
    assert evolve(spark, grow, init, 0).num_states("None") == 1
    assert evolve(spark, grow, init, 2, max_successors=1).num_events() == 2
    assert evolve(spark, grow, init, 3, max_states_per_step=3).states.groupBy("step").count().agg({"count": "max"}).first()[0] == 3
    assert evolve(spark, grow, init, 2, max_events=5).num_events() == 5
    assert evolve(spark, grow, init, 2, max_states=4).num_states("None") == 4
    assert evolve(spark, grow, init, 2, exploration_probability=0.0).num_events() == 0
    assert evolve(spark, grow, init, 1, transition_rate=0.0).num_events() == 0
    assert evolve(spark, grow, init, 2, transition_rate=1e-12).num_events() == 2  # the spine alone
    assert evolve(spark, grow, init, 2, matches_per_state_rule=1, seed=12345).num_events() == 2
    two = evolve(spark, grow, init, 2, matches_per_state_rule=2, seed=12345)
    assert two.num_events() == 6
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    again = evolve(spark, grow, init, 2, matches_per_state_rule=2, seed=12345)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(str, two.events.collect())) == sorted(map(str, again.events.collect()))
    with pytest.raises(TypeError):
        evolve(spark, grow, init, 1, unknown=1)
    with pytest.raises(ValueError):
        evolve(spark, grow, init, 1, transition_rate=2.0)


def test_sessions(spark):
    rule = ([(1, 2)], [(1, 3), (3, 2)])
    with Session(spark, rule, [[1, 2]]) as s:
        counts = [(s.evolution.num_states("None"), s.evolution.n_events)]
        parts = s.delta("EvolutionCausalBranchialGraph")
        for _ in range(3):
            s.step()
            counts.append((s.evolution.num_states("None"), s.evolution.n_events))
            new = s.delta("EvolutionCausalBranchialGraph")
            parts = new if parts is None else merged(parts, new)
        assert counts == [(1, 0), (2, 1), (4, 3), (10, 9)]
        assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, s.query("EvolutionCausalBranchialGraph").collect()))
        one = evolve(spark, rule, [[1, 2]], 3)
        assert sorted(map(str, one.events.collect())) == sorted(map(str, s.evolution.events.collect()))
        with pytest.raises(ValueError):
            s.query("NoGraph")
    with pytest.raises(ValueError):
        s.step()
    steered = Session(spark, rule, [[1, 2]]).step(2)
    first = min(r.state_id for r in steered.frontier().collect())
    steered.step(only=[first])
    assert steered.evolution.num_states("None") == 7
    with pytest.raises(ValueError):
        steered.step(only=[0])
    assert steered.step().evolution.num_states("None") == 34


def test_roots_and_emptying(spark):
    e = evolve(spark, ([(0, 1)], []), [[[1, 2]], [[10, 20], [20, 30]]], 2)
    assert e.num_events() == 1 + 2 + 2
    assert e.num_states("Full") == 3  # one edge, a path, nothing
    assert e.states.where("size(edges) = 0").count() == 3
    assert initial_states(spark, [[], [[], [-1]], [[5, 6, 5]]]).collect()[0].verts == [[0, 1, 0]]
    for kind in GRAPHS:
        assert e.graph(kind).columns == ["src_kind", "src", "dst_kind", "dst", "type"]
    assert e.graph("StatesGraph", "Full").count() == 5
    assert e.global_edges().count() == 3 and e.state_bitvectors().count() == e.states.count()


def test_canonical_search_survives_symmetry():
    import random
    import time

    rng = random.Random(1)
    for edges in (
        [(2 * i, 2 * i + 1) for i in range(1000)],
        [(i,) for i in range(1100)],
        [(i, j) for i in range(8) for j in range(8) if i != j],
        [(i, (i + 1) % 100) for i in range(100)],
        [(0, i) for i in range(1, 400)],
        [(a, a ^ 1 << k) for a in range(16) for k in range(4)],
    ):
        start = time.time()
        form = canonical.canonical(edges)[0]
        assert time.time() - start < 2
        names = list({v for e in edges for v in e})
        other = dict(zip(names, rng.sample(names, len(names)), strict=True))
        assert canonical.canonical(rng.sample([tuple(other[v] for v in e) for e in edges], len(edges)))[0] == form


def test_canonical_orbits_by_brute_force():
    import itertools
    import random

    rng = random.Random(2)
    for _ in range(400):
        n = rng.randint(1, 5)
        edges = [tuple(rng.randrange(n) for _ in range(rng.choice([1, 2, 2, 3]))) for _ in range(rng.randint(1, 6))]
        names = sorted({v for e in edges for v in e})
        maps = [dict(zip(names, p, strict=True)) for p in itertools.permutations(names)]
        kept = [m for m in maps if sorted(tuple(m[v] for v in e) for e in edges) == sorted(edges)]
        want = [min(j for m in kept for j, f in enumerate(edges) if tuple(m[v] for v in e) == f) for e in edges]
        form, label, _, orbit = canonical.canonical(edges)
        assert orbit == want and form == tuple(sorted(tuple(label[v] for v in e) for e in edges))
