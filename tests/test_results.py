"""Replay of quotients, results by name, event identities, genesis."""

import pytest

from braidwork import rules as R
from braidwork.operators import canonical, relations
from braidwork.plans import results
from braidwork.plans.evolve import Evolution, Options, evolve
from braidwork.plans.replay import replay

TWINS = [
    ([([(0, 1), (1, 2)], [(0, 1), (1, 3), (3, 2)])], [[0, 1], [1, 2], [2, 3], [3, 0]], 3),
    ([([(0, 1)], [(0, 2), (1, 2)]), ([(0, 1), (1, 2)], [(0, 2)])], [[0, 1], [1, 2]], 2),
    ([([(1, 2), (2, 3)], [(1, 2), (2, 3), (2, 4)])], [[[1, 1], [1, 1]], [[5, 5], [5, 5]], [[1, 2]]], 3),
]


@pytest.mark.parametrize(("rules", "init", "steps"), TWINS)
def test_replay_equals_full(spark, rules, init, steps):
    q = replay(Evolution(spark, R.rules(rules), Options(), quotient=True).start(init).step(steps))
    full = evolve(spark, rules, init, steps)
    assert q.num_events() == full.num_events() and q.num_states() == full.num_states("None")
    for reduce in (False, True):
        a, b = q.causal(reduce), full.causal(reduce)
        assert a.count() == b.count()
        assert relations.causal_pairs(a).count() == relations.causal_pairs(b).count()
    assert q.branchial().count() == full.branchial().count()
    assert q.branchial(-1).count() == full.branchial(-1).count()
    by = lambda e: sorted(map(tuple, e.events.groupBy("root", "step", "rule").count().collect()))
    assert by(q) == by(full)


def test_replay_bounds(spark):
    none = replay(Evolution(spark, R.rules([([(0, 1)], [])]), Options(), quotient=True).start([[0, 1]]))
    assert none.num_events() == 0 and none.causal().count() == 0
    with pytest.raises(ValueError):
        replay(evolve(spark, [([(0, 1)], [])], [[0, 1]], 1))


def test_results(spark):
    e = evolve(spark, [([(0, 1)], [(0, 2), (1, 2)])], [[0, 1]], 3)
    assert results.result(e, "Debug") == {"NumStates": 6, "NumEvents": 9, "NumCausalEdges": 8, "NumBranchialEdges": 0}
    every = results.result(e, "All", event_mode="Full", canonical_hashes=True)
    assert set(every) == set(results.PROPERTIES)
    assert every["States"].count() == 6 and len({r.CanonicalHash for r in every["States"].collect()}) == 6
    assert every["NumEvents"] == 5 and len({r.CanonicalId for r in every["Events"].collect()}) == 5
    assert every["CausalEdges"].columns == ["From", "To", "RawFrom", "RawTo"] and every["CausalEdges"].count() == 8
    assert results.result(e, ["Warnings"]) == {"Warnings": []}
    with pytest.raises(ValueError):
        results.result(e, "Nothing")
    with pytest.raises(TypeError):
        results.result(e, "States", colour="red")
    assert e.num_events(["Rule"]) == 1 and e.num_events(["InputState", "OutputState"]) == e.num_events("Full") == 5
    assert e.num_events("Full") <= e.num_events("Positional") <= 9
    with pytest.raises(ValueError):
        e.num_events(["Colour"])
    assert canonical.fingerprint(e.state_keys("Full")).first().states == 6


def test_genesis(spark):
    e = evolve(spark, [([(0, 1), (1, 2)], [(0, 2)])], [[[0, 1], [1, 2], [2, 3], [3, 4]], [[7, 7], [7, 7]]], 3)
    rows = results.events(e, "None", genesis=True).collect()
    assert sorted((r.Id, r.RuleIndex, r.RawInput) for r in rows if r.Id < 0) == [(-2, -1, -1), (-1, -1, -1)]
    assert [len(r.Produced) for r in rows if r.Id == -2] == [2]
    every = relations.causal_pairs(e.causal_with_genesis(False)).selectExpr("producer AS src", "consumer AS dst")
    kept = relations.causal_pairs(e.causal_with_genesis()).collect()
    assert sorted(map(tuple, relations.reduced(every).collect())) == sorted(map(tuple, kept))


def test_correspondence():
    a, b = [(0, 1), (1, 2), (2, 2)], [(5, 5), (4, 5), (3, 4)]
    assert canonical.correspondence(a, b) == [2, 1, 0]
    assert canonical.correspondence(a, [(0, 1)]) is None


@pytest.mark.parametrize(("speed", "cutoff"), [(1.0, float("inf")), (0.5, 0.3)])
def test_light_cone(spark, speed, cutoff):
    from braidwork.sources import generators

    points = generators.sprinkled(spark, 150, seed=4)
    rows = points.collect()
    near = lambda a, b: (b.t - a.t) ** 2 - (b.x - a.x) ** 2 / speed**2
    want = sorted((a.id, b.id) for a in rows for b in rows if b.t > a.t and 0 < near(a, b) <= cutoff**2)
    assert sorted(map(tuple, generators.light_cone(points, speed, cutoff).collect())) == want and want
    odd = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, None, 1.0)], "id long, t double, x double")
    assert generators.light_cone(odd).count() == 0 and generators.light_cone(odd.limit(0)).count() == 0


def test_automatic_keys_count_like_automatic_events(spark):
    for rules, init, steps in TWINS:
        e = evolve(spark, rules, init, steps)
        keys = e.event_keys("Automatic")
        assert keys.count() == e.num_events() and keys.select("key").distinct().count() == e.num_events("Automatic")
    assert results.result(e, "Events", event_mode="Automatic").count() == e.num_events()
    table = {r.step: r for r in e.per_step_table().collect()}
    assert table[3].events_automatic == e.num_events("Automatic") and table[3].states == e.num_states("Full") and table[3].events_full == e.num_events("Full")
    assert e.statistics().agg({"events": "sum"}).first()[0] == e.num_events()


def test_graphs_obey_their_options(spark):
    e = evolve(spark, *TWINS[0])
    pairs = {k: e.branchial(k).count() for k in (0, 1, 2, -1)}
    assert len(set(pairs.values())) > 1
    for k, n in pairs.items():
        assert results.result(e, "BranchialGraph", state_mode="None", branchial_step=k).count() == n == results.result(e, "BranchialStateEdges", branchial_step=k).count()
    assert results.result(e, "BranchialGraph").count() == pairs[-1]
    full = e.graph_vertices("EvolutionGraph", "Full", "Full")
    ends = e.graph("EvolutionGraph", "Full", "Full")
    want = {(r.src_kind, r.src) for r in ends.collect()} | {(r.dst_kind, r.dst) for r in ends.collect()}
    assert {(r.kind, r.id) for r in full.collect()} == want and full.count() == len(want)
    assert e.graph("CausalGraph", dedup=False).columns[-1] == "edge_index"


def test_draws_dont_depend_on_numbers(spark):
    """States of equal content draw alike wherever they stand, whole or as quotient; another seed draws otherwise."""
    one = [[0, 1], [1, 2], [2, 3], [3, 0], [0, 2]]
    path = [([(0, 1), (1, 2)], [(0, 2)])]
    drawn = {}
    for seed in (5, 6):
        e = evolve(spark, path, [[[7, 7]], one, [[3, 3], [3, 3]], one], 1, transition_rate=0.5, seed=seed)
        rows = [(r.root, [x - r.root * 5 for x in r.consumed]) for r in e.events.collect()]
        drawn[seed] = sorted(c for root, c in rows if root == 1)
        assert drawn[seed] and drawn[seed] == sorted(c for root, c in rows if root == 3)
    assert drawn[5] != drawn[6]
    # A quotient's draws go by class: other names and another order of the edges change nothing.
    turned = [[9, 8], [6, 9], [8, 7], [9, 7], [7, 6]]
    forms = []
    for state in (one, turned):
        e = Evolution(spark, R.rules(path), Options(transition_rate=0.5, seed=5), quotient=True).start([state]).step(2)
        forms.append((e.num_events(), sorted(r.form for r in e.class_rows.collect())))
    assert forms[0] == forms[1]


def test_quotient_counts_are_raw(spark):
    """Counts by name of a quotient exploration are those of the whole evolution that it stands for."""
    rules, init = [([(0, 1), (1, 2)], [(0, 1), (1, 3), (3, 2)])], [[0, 1], [1, 2], [2, 3], [3, 0]]
    whole = evolve(spark, rules, init, 2)
    q = Evolution(spark, R.rules(rules), Options(), quotient=True).start(init).step(2)
    assert q.num_events() < whole.num_events()
    for how in ({}, {"genesis": True}, {"reduce": False}, {"genesis": True, "reduce": False}):
        for name in ("NumEvents", "NumCausalEdges", "NumBranchialEdges"):
            assert results.result(q, name, **how) == results.result(whole, name, **how)
    assert results.result(whole, "NumCausalEdges", genesis=True) == relations.causal_pairs(whole.causal_with_genesis()).count()


def test_stop_seal_and_completion(spark):
    grow, seen = [([(0, 1)], [(0, 2), (1, 2)])], []

    def done(e, depth):
        seen.append((depth, e.n_events))
        if depth == 1:
            e.request_stop()

    e = Evolution(spark, R.rules(grow), on_depth=done).start([[0, 1]]).step(4)
    assert seen == [(0, 1), (1, 3)] and e.steps == 2 and e.warnings[-1]["kind"] == "Stopped"
    assert e.step().steps == 3 and e.num_events() == evolve(spark, grow, [[0, 1]], 3).num_events()
    with pytest.raises(RuntimeError):
        e.seal().step()


def test_pairs_in_the_row(spark):
    """Pairs that share several edges come once, with the least one."""
    e = evolve(spark, [([(0, 1), (1, 0)], [(0, 1), (1, 0)])], [[0, 1], [1, 0], [0, 1]], 2)
    pairs = e.branchial().collect()
    triples = relations.branchial_triples(e.consumed).groupBy("event1", "event2").agg({"shared_edge": "min"}).collect()
    assert sorted(map(tuple, pairs)) == sorted(map(tuple, triples)) and len({(p.event1, p.event2) for p in pairs}) == len(pairs)
    for reduce in (True, False):
        assert sorted(map(tuple, e.causal_pairs(reduce).collect())) == sorted(map(tuple, relations.causal_pairs(e.causal(reduce)).collect()))
        assert sorted(map(tuple, e.causal_pairs(reduce, True).collect())) == sorted(map(tuple, relations.causal_pairs(e.causal_with_genesis(reduce)).collect()))
