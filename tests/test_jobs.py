"""Jobs and sessions said in JSON; places of lattices; colours."""

import json
import math

import pytest

from braidwork.plans.jobs import Worker, parse
from braidwork.sources import coordinates, generators

GROW = {"Rules": {"r": [[[1, 2]], [[1, 3], [3, 2]]]}, "InitialEdges": [[1, 2]]}


def test_one_job(spark):
    job = GROW | {"Steps": 3, "Options": {"RequestedData": ["NumStates", "NumEvents", "States"], "CanonicalizeStates": "None", "Nonsense": "True", "TransitionRate": 7}}
    out = Worker(spark).run(json.dumps(job))
    assert (out["NumStates"], out["NumEvents"]) == (10, 9)
    assert out["States"].count() == 10
    assert [w["context"].split()[0].strip(":") for w in out["Warnings"] if w["kind"] == "OptionSkipped"] == ["Nonsense", "TransitionRate"]
    assert set(Worker(spark).run(GROW)) == {"EvolutionCausalBranchialGraph", "Warnings"}


def test_session(spark):
    w = Worker(spark)
    opened = w.run(GROW | {"Op": "Open", "Options": {"CanonicalizeStates": "None", "RequestedData": ["NumStates", "NumEvents"]}})
    assert opened["Session"] == 1
    with pytest.raises(ValueError):
        w.run(GROW | {"Op": "Open"})
    counts = [(a["NumStates"], a["NumEvents"]) for a in (w.run({"Op": "Query", "Session": 1}), *(w.run({"Op": "Step", "Session": 1, "Steps": 1}) for _ in range(3)))]
    assert counts == [(1, 0), (2, 1), (4, 3), (10, 9)]
    new = [w.run({"Op": "Query", "Session": 1, "Delivery": "Delta", "Options": {"GraphProperties": ["StatesGraph"]}})["StatesGraph"].count() for _ in range(2)]
    assert new == [9, 0]
    assert w.run({"Op": "Frontier", "Session": 1})["Frontier"].count() == 6
    assert w.run({"Op": "Close", "Session": 1}) == {"Session": 1}
    with pytest.raises(ValueError):
        w.run({"Op": "Query", "Session": 1})
    assert w.run(GROW | {"Op": "Open"})["Session"] == 2


@pytest.mark.parametrize("bad", [{"Steps": -1}, {"Op": "Dance"}, {"Rules": {"r": [[], [[1, 2]]]}}])
def test_bad_jobs(bad):
    with pytest.raises(ValueError):
        parse(GROW | bad)


def test_options():
    assert parse(GROW | {"Options": {"UniformRandom": "True", "MatchesPerStep": 4}}).evolve["max_states_per_step"] == 4
    assert "max_states_per_step" not in parse(GROW | {"Options": {"MatchesPerStep": 4}}).evolve
    assert parse(GROW | {"Options": {"CanonicalizeEvents": ["InputState", "Rule"]}}).result["event_mode"] == ["InputState", "Rule"]


def test_places(spark):
    for kind, how in (("Grid", {"width": 4, "height": 3}), ("Cylinder", {"resolution": 5, "height": 3}), ("Torus", {"resolution": 5}), ("Sphere", {"resolution": 5}), ("KleinBottle", {"resolution": 5, "height": 3}), ("MobiusStrip", {"resolution": 5, "width": 1})):
        rows = coordinates.coordinates(spark, kind, **how).collect()
        ends = {v for e in generators.generate(spark, kind, **how).collect() for v in (e.src, e.dst)}
        assert {r.v for r in rows} == ends and len(rows) == len(ends)
        if kind == "Sphere":
            assert all(math.isclose(math.hypot(r.px, r.py, r.pz), 10) for r in rows)
    with pytest.raises(ValueError):
        coordinates.coordinates(spark, "Nowhere")


def test_sprinkling_is_dense(spark):
    rows = sorted(generators.sprinkled(spark, 9000, seed=2).collect())
    assert [r.id for r in rows] == list(range(1, 9001))
    assert [r.t for r in rows] == sorted(r.t for r in rows)


def test_positional_needs_raw_states(spark):
    job = {"InitialEdges": [[0, 1], [1, 2]], "Rules": {"r": [[[0, 1], [1, 2]], [[0, 2]]]}, "Steps": 1}
    job["Options"] = {"ExploreFromCanonicalStatesOnly": True, "CanonicalizeEvents": "Positional", "RequestedData": ["NumEvents"]}
    out = Worker(spark).run(job)
    assert out["NumEvents"] == 1 and [w["kind"] for w in out["Warnings"]] == ["QuotientDisabled"]
