"""Sessions: an evolution that is opened, stepped, steered and read in deltas; and matching on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork import rules as R
from braidwork.operators.match import matches
from braidwork.operators.relations import checkpointed
from braidwork.plans.evolve import Evolution, Options


class Session:
    """Rules and options are fixed when it is opened; stepping gives what one run to the same depth gives."""

    def __init__(self, spark: SparkSession, rules: object, init: object, quotient: bool = False, **options: object) -> None:
        self.evolution = Evolution(spark, R.rules(rules), Options(**options), quotient).start(init)
        self.sent: dict[str, DataFrame | int] = {}  # by kind: edges, or the number of the events' parts that were sent
        self.open = True

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _live(self) -> Evolution:
        if not self.open:
            raise ValueError("the session is closed")
        return self.evolution

    def step(self, n: int = 1, only: list[int] | DataFrame | None = None) -> Session:
        self._live().step(n, only)
        return self

    def frontier(self, state_mode: str = "None") -> DataFrame:
        return self._live().frontier(state_mode)

    def query(self, kind: str, **how: object) -> DataFrame:
        """All edges of a graph, without exploring; how: see Evolution.graph."""
        return self._live().graph(kind, **how)

    def vertices(self, kind: str, **how: object) -> DataFrame:
        """All vertices of a graph; how: see Evolution.graph_vertices."""
        return self._live().graph_vertices(kind, **how)

    def delta(self, kind: str, **how: object) -> DataFrame:
        """Edges of a graph that no earlier delta of it, asked for in the same way, held; the first holds all."""
        key = f"{kind} {sorted(how.items())}"
        if kind != "BranchialGraph" and set(how) <= {"dedup"}:  # each raw edge comes with one event, so that new events have all new edges
            before, self.sent[key] = self.sent.get(key, 0), len(self._live().event_parts)
            return self.evolution.since(before).graph(kind, **how)
        return self._new(key, self.query(kind, **how))

    def delta_vertices(self, kind: str, **how: object) -> DataFrame:
        """Vertices of a graph that no earlier delta of them held."""
        return self._new(f"{kind} vertices {sorted(how.items())}", self.vertices(kind, **how))

    def _new(self, key: str, rows: DataFrame) -> DataFrame:
        rows = checkpointed(rows.distinct())
        before = self.sent.get(key)
        same = None if before is None else [rows[c].eqNullSafe(before[c]) for c in rows.columns]
        self.sent[key] = rows
        return rows if before is None else rows.join(before, same, "left_anti")

    def close(self) -> None:
        self.open = False


def merged(earlier: DataFrame, delta: DataFrame) -> DataFrame:
    """What a reader holds after a delta: earlier edges and new ones."""
    return earlier.unionByName(delta).distinct()


def match_stream(states: DataFrame, rules: object) -> DataFrame:
    """Matches on a stream of states (state_id, edges): narrow, so no watermark or state is needed."""
    return matches(states.select(F.col("state_id"), "edges"), R.rules(rules))
