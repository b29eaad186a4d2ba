"""Jobs: an evolution or one verb on a session, said in JSON.

A job names Op (Evolve if it doesn't), InitialStates or InitialEdges, Rules, Steps, Options, and on
sessions Session, From and Delivery. Options that aren't known, or whose value doesn't fit, are skipped
with a warning; a malformed rule, state or count of steps is an error.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from braidwork import rules as R
from braidwork.operators.relations import branchial_step
from braidwork.plans import results
from braidwork.plans.evolve import EVENT_KEYS, EVENT_MODES, GRAPHS, MODES, Evolution
from braidwork.streaming import Session

OPS = ("Evolve", "Open", "Step", "Query", "Frontier", "Close")


def _flag(x: object) -> bool:
    if x in (True, "True"):
        return True
    if x in (False, "False"):
        return False
    raise ValueError("neither True nor False")


def _limit(x: object) -> int | None:
    """A bound; 0 is none."""
    if isinstance(x, bool) or int(x) != x or x < 0:
        raise ValueError("not a count")
    return int(x) or None


def _share(x: object) -> float:
    if not 0 <= float(x) <= 1:
        raise ValueError("not from 0 to 1")
    return float(x)


def _state_mode(x: object) -> str:
    mode = {"False": "None", "True": "Full"}.get(str(x), str(x))
    if mode not in MODES:
        raise ValueError(f"not one of {MODES}")
    return mode


def _event_mode(x: object) -> str | list[str]:
    named = [x] if isinstance(x, str) else list(x)
    if isinstance(x, str) and x not in ("None", "Automatic", *EVENT_MODES) or not isinstance(x, str) and set(named) - set(EVENT_KEYS):
        raise ValueError("no such event identity")
    return x if isinstance(x, str) else named or "None"


def _names(known: Mapping) -> Callable[[object], list[str]]:
    def read(x: object) -> list[str]:
        if isinstance(x, str) or (unknown := sorted(set(x) - set(known))):
            raise ValueError(f"unknown {unknown if not isinstance(x, str) else x}")
        return list(x)

    return read


#: Option: the part of a job it belongs to, its name there, and how its value is read.
OPTIONS: dict[str, tuple[str, str, Callable[[object], object]]] = {
    "MaxSuccessorStatesPerParent": ("evolve", "max_successors", _limit),
    "MaxStatesPerStep": ("evolve", "max_states_per_step", _limit),
    "MatchesPerStep": ("own", "matches_per_step", _limit),
    "UniformRandom": ("own", "uniform", _flag),
    "MatchesPerStateRule": ("evolve", "matches_per_state_rule", _limit),
    "RandomSeed": ("evolve", "seed", int),
    "ExplorationProbability": ("evolve", "exploration_probability", _share),
    "TransitionRate": ("evolve", "transition_rate", _share),
    "RuleWeights": ("evolve", "rule_weights", lambda x: tuple(map(float, x))),
    "BranchialStep": ("result", "branchial_step", int),
    "IncludeCanonicalHashes": ("result", "canonical_hashes", _flag),
    "CanonicalizeStates": ("result", "state_mode", _state_mode),
    "CanonicalizeEvents": ("result", "event_mode", _event_mode),
    "EdgeDeduplication": ("result", "edge_dedup", _flag),
    "ShowGenesisEvents": ("result", "genesis", _flag),
    "CausalTransitiveReduction": ("result", "reduce", _flag),
    "ExploreFromCanonicalStatesOnly": ("own", "quotient", _flag),
    "RequestedData": ("own", "data", _names(results.PROPERTIES)),
    "GraphProperties": ("own", "graphs", _names(GRAPHS)),
}


@dataclass
class Job:
    op: str = "Evolve"
    init: list = field(default_factory=list)
    rules: list[R.Rule] = field(default_factory=list)
    steps: int = 1
    session: int = 0
    only: list[int] | None = None
    delta: bool = False
    evolve: dict = field(default_factory=dict)
    result: dict = field(default_factory=dict)
    own: dict = field(default_factory=dict)
    warnings: list[dict] = field(default_factory=list)


def parse(job: str | Mapping) -> Job:
    """A job from JSON, or from what it stands for."""
    spec = json.loads(job) if isinstance(job, str) else job
    out = Job(op=spec.get("Op", "Evolve"), session=int(spec.get("Session", 0)), only=spec.get("From"), delta=spec.get("Delivery") == "Delta")
    if out.op not in OPS:
        raise ValueError(f"unknown operation {out.op}")
    out.init = list(spec.get("InitialStates", ())) or ([spec["InitialEdges"]] if spec.get("InitialEdges") else [])
    written = spec.get("Rules", {})
    out.rules = R.rules([tuple(r) for r in (written.values() if isinstance(written, Mapping) else written)])
    out.steps = int(spec.get("Steps", 1))
    if out.steps < 0:
        raise ValueError("Steps is negative")
    for name, value in spec.get("Options", {}).items():
        if name not in OPTIONS:
            out.warnings.append({"kind": "OptionSkipped", "count": 1, "context": f"{name} is unknown"})
            continue
        part, key, read = OPTIONS[name]
        try:
            getattr(out, part)[key] = read(value)
        except (TypeError, ValueError) as e:
            out.warnings.append({"kind": "OptionSkipped", "count": 1, "context": f"{name}: {e}"})
    if out.own.get("uniform") and out.own.get("matches_per_step"):
        out.evolve["max_states_per_step"] = out.own["matches_per_step"]
    return out


def _answer(job: Job, e: Evolution, graph: Callable[[str], DataFrame] | None = None) -> dict[str, object]:
    """What a job asks for, by name."""
    data, graphs = job.own.get("data"), job.own.get("graphs")
    if data is None and graphs is None:
        graphs = ["EvolutionCausalBranchialGraph"]
    out: dict[str, object] = {n: results.result(e, n, **job.result) for n in data or ()}
    out |= {n: graph(n) if graph else results.result(e, n, **job.result) for n in graphs or ()}
    return out | {"Warnings": [*e.warnings, *job.warnings]}


class Worker:
    """Runs jobs one after another and holds at most one session. Handles count from 1 and never come back."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.handle, self.session, self.opened = spark, 0, None, None

    def run(self, job: str | Mapping) -> dict[str, object]:
        """Names and results (DataFrames, counts, lists) of a job; Session where it has one."""
        j = parse(job)
        if j.op == "Evolve":
            return _answer(j, self._start(j).step(j.steps).evolution)
        if j.op == "Open":
            if self.session:
                raise ValueError(f"session {self.handle} is open")
            self.session, self.opened = self._start(j), j
            self.handle += 1
            return {"Session": self.handle, "Warnings": [*self.session.evolution.warnings, *j.warnings]}
        if not self.session or j.session != self.handle:
            raise ValueError(f"session {j.session} isn't open")
        if j.op == "Close":
            self.session.close()
            self.session = None
            return {"Session": j.session}
        if j.op == "Frontier":
            return {"Session": j.session, "Frontier": self.session.frontier((self.opened.result | j.result).get("state_mode", "Full"))}
        if j.op == "Step":
            self.session.step(j.steps, j.only)
        j.result, j.own = self.opened.result | j.result, self.opened.own | j.own
        branchial_step(j.result.get("branchial_step") or 0, self.session.evolution.steps)
        return {"Session": j.session} | _answer(j, self.session.evolution, self._delta(j.result) if j.delta else None)

    def _delta(self, how: dict) -> Callable[[str], DataFrame]:
        how = {k: v for k, v in (results.DEFAULTS | how).items() if k in ("state_mode", "event_mode", "branchial_step", "edge_dedup")}
        how["dedup"] = how.pop("edge_dedup")
        return lambda kind: self.session.delta(kind, **how)

    def _start(self, j: Job) -> Session:
        if not j.rules or not j.init:
            raise ValueError("a job needs rules and an initial state")
        quotient = bool(j.own.get("quotient"))
        if quotient and j.result.get("event_mode") == "Positional":
            quotient = False
            j.warnings.append({"kind": "QuotientDisabled", "count": 1, "context": "Positional event identity needs raw states, which a quotient doesn't make"})
        return Session(self.spark, j.rules, j.init, quotient, **j.evolve)
