"""Raw events of a quotient exploration, replayed from the one expansion of each class.

A class is a frame of places: its canonical form's edges. A recorded expansion says which places a move
consumes and, for each place of the class that it leads to, which place of the old frame
is carried there, or that the move produced it. An instance is a raw state that knows its class and, by place, which
event made the edge; a move applied to an instance is one raw event. Nothing is matched or
canonicalized again: a step is one join of instances and moves on the class. How many events follow an instance, step by step, and
how many of them follow earlier moves, depends on its class alone, so that only the roots are counted up to number all events.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.operators import relations
from braidwork.operators.listing import BLOCK
from braidwork.operators.relations import checkpointed
from braidwork.plans.evolve import Evolution, ancestry

MAKER = "array<struct<creator:bigint,cdepth:int>>"


def moves(e: Evolution) -> tuple[DataFrame, DataFrame]:
    """Roots (state_id, root, class_id, places) and moves (class_id, move, rule, used_places, to_class, carried).

    class_id is the class's expanded state, carried has -1 where the move produced the edge.
    """
    framed = e._all(e.frame_parts)
    classes = e.class_rows.select("form", F.col("state_id").alias("class_id"))
    place = F.transform("edges", lambda x: x["edge_id"])
    framed = checkpointed(framed.join(classes, "form").select("state_id", "step", "root", "class_id", place.alias("ids"), "ranks"))
    roots = framed.where("step = 0").select("state_id", "root", "class_id", F.size("ids").alias("places"))
    before = framed.select(F.col("state_id").alias("input_state"), F.map_from_arrays("ids", "ranks").alias("at"), F.col("class_id").alias("from_class"))
    after = framed.select(F.col("state_id").alias("output_state"), F.transform(F.array_sort(F.arrays_zip("ranks", "ids")), lambda x: x["ids"]).alias("to_ids"), F.col("class_id").alias("to_class"))
    rows = e.events.join(before, "input_state").join(after, "output_state")
    used = F.transform("consumed", lambda c: F.element_at("at", c))
    carried = F.transform("to_ids", lambda x: F.coalesce(F.try_element_at("at", x), F.lit(-1)))
    return roots, checkpointed(rows.select(F.col("from_class").alias("class_id"), F.col("event_id").alias("move"), "rule", used.alias("used_places"), "to_class", carried.alias("carried")))


def followed(recorded: DataFrame, steps: int) -> tuple[DataFrame, DataFrame]:
    """By class (class_id, ahead) how many events follow 1, 2, .. steps on; recorded with nth, a move's place among its class's, and before, how many events follow earlier moves of its class in 2, 3, .. steps."""
    ahead = checkpointed(recorded.groupBy("class_id").agg(F.array(F.count("*")).alias("ahead")))

    def led() -> DataFrame:
        return recorded.join(ahead.withColumnRenamed("class_id", "to_class"), "to_class", "left")

    def then(k: int) -> Column:
        return F.coalesce(F.get("ahead", F.lit(k)), F.lit(0).cast("long"))

    for k in range(steps - 1):
        more = led().groupBy("class_id").agg(F.sum(then(k)).alias("_more"))
        ahead = checkpointed(ahead.join(more, "class_id").select("class_id", F.concat("ahead", F.array("_more")).alias("ahead")))
    own = Window.partitionBy("class_id").orderBy("move")
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    before = F.array(*(F.coalesce(F.sum(then(k)).over(earlier), F.lit(0).cast("long")) for k in range(steps - 1))).cast("array<bigint>")
    return ahead, checkpointed(led().select(*recorded.columns, (F.row_number().over(own) - 1).alias("nth"), before.alias("before")))


def started(roots: DataFrame, ahead: DataFrame, steps: int) -> tuple[DataFrame, list[int]]:
    """roots that have moves, with starts: how many events of step 1, 2, .. follow roots before them; and how many there are of each.

    Blocks of neighbouring roots are summed up apart, then their totals.
    """
    rows = roots.join(ahead, "class_id").withColumn("_block", F.floor(F.col("state_id") / BLOCK))
    here = Window.partitionBy("_block").orderBy("state_id").rowsBetween(Window.unboundedPreceding, 0)
    inner = [F.sum(F.get("ahead", F.lit(k))).over(here) - F.get("ahead", F.lit(k)) for k in range(steps)]
    rows = checkpointed(rows.withColumn("_in", F.array(*inner)))
    totals = rows.groupBy("_block").agg(*(F.sum(F.get("ahead", F.lit(k))).alias(f"n{k}") for k in range(steps)))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    base = checkpointed(totals.withColumn("_base", F.array(*(F.sum(f"n{k}").over(earlier) - F.col(f"n{k}") for k in range(steps)))))
    counts = base.agg(*(F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in range(steps))).first()
    starts = F.zip_with("_in", "_base", lambda a, b: a + b).alias("starts")
    return rows.join(F.broadcast(base.select("_block", "_base")), "_block").select(*roots.columns, starts), list(counts)


@dataclass
class Replay:
    """events: event_id, rule, step, root, input_state, output_state, from_class, to_class, consumed (places), causes.

    groups: step, class_id and first, the number of the first event, of each instance that has any. pairs: class_id, event1, event2
    (places of two moves among the class's), shared_edge (the least place that both consume).
    """

    events: DataFrame
    groups: DataFrame
    pairs: DataFrame
    n_events: int
    n_roots: int
    steps: int

    def num_events(self) -> int:
        return self.n_events

    def num_states(self) -> int:
        return self.n_roots + self.num_events()

    def causal(self, reduce: bool = True) -> DataFrame:
        """producer, consumer, edge_id (the place in the consumer's input frame); as Evolution.causal."""
        rows = self.events.select(F.col("event_id").alias("consumer"), F.explode("causes").alias("c")).select("c.producer", "consumer", "c.edge_id", "c.kept")
        return (rows.where("kept") if reduce else rows).drop("kept")

    def causal_pairs(self, reduce: bool = True, genesis: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
        """producer, consumer, and the consumer's columns keep; see relations.caused."""
        return relations.caused(self.events, reduce, genesis, keep)

    def branchial(self, step: int = 0, with_step: bool = False) -> DataFrame:
        """event1, event2, shared_edge (a place), as Evolution.branchial: moves of a class that meet do so in each of its instances."""
        at = relations.branchial_step(step, self.steps)
        rows = self.groups if at is None else self.groups.where(F.col("step") == at)
        met = rows.join(self.pairs, "class_id")
        return met.select((F.col("first") + F.col("event1")).alias("event1"), (F.col("first") + F.col("event2")).alias("event2"), "shared_edge", *(["step"] if with_step else []))


def replay(e: Evolution) -> Replay:
    """All raw events that a quotient exploration stands for, to its depth."""
    if not e.quotient:
        raise ValueError("only a quotient exploration is replayed")
    if not e.event_parts:
        nothing = lambda columns: e.spark.createDataFrame([], columns)
        events = nothing("event_id long, rule int, step int, root long, input_state long, output_state long, from_class long, to_class long, consumed array<int>, causes array<struct<producer:bigint,edge_id:int,kept:boolean>>")
        return Replay(events, nothing("step int, class_id long, first long"), nothing("class_id long, event1 long, event2 long, shared_edge int"), 0, e.n_roots, e.steps)
    roots, recorded = moves(e)
    ahead, recorded = followed(recorded, e.steps)
    roots, counts = started(roots, ahead, e.steps)
    pairs = relations.branchial_pairs(recorded.select(F.col("class_id").alias("input_state"), F.col("nth").alias("event_id"), F.col("used_places").alias("consumed"), "class_id"), ("class_id",))
    none = F.array().cast("array<struct<event_id:bigint,anc:bigint>>")
    unmade = F.transform(F.array_repeat(F.lit(0), F.col("places")), lambda _: F.struct(F.lit(None).cast("long").alias("creator"), F.lit(None).cast("int").alias("cdepth")))
    now = roots.select("state_id", "root", "class_id", unmade.cast(MAKER).alias("makers"), none.alias("hist"), "starts")
    parts, groups, n = [], [], 0
    for step in range(1, e.steps + 1):
        first = F.get("starts", F.lit(0)) + n
        found = now.join(recorded, "class_id").withColumn("event_id", first + F.col("nth"))
        found = found.withColumn("used", F.transform("used_places", lambda p: F.get("makers", p)))
        own = f"named_struct('creator', event_id, 'cdepth', {step})"
        makers = F.expr(f"transform(carried, p -> if(p < 0, {own}, get(makers, p)))").cast(MAKER)
        causes = F.expr("transform(filter(arrays_zip(used, used_places), z -> z.used.creator is not null), z -> named_struct('producer', z.used.creator, 'edge_id', z.used_places, 'kept', (_reach & shiftleft(1L, z.used.cdepth)) = 0L))")
        hist = F.concat("hist", F.array(F.struct(F.col("event_id"), F.col("_direct").bitwiseOR(F.col("_reach")).alias("anc"))))
        starts = F.zip_with(F.slice("starts", 2, e.steps), F.slice("before", 1, e.steps - step), lambda a, b: a + b)
        rows = ancestry(found).select(
            "event_id", "rule", F.lit(step).alias("step"), "root", F.col("state_id").alias("input_state"), (F.col("event_id") + e.state0).alias("output_state"),
            F.col("class_id").alias("from_class"), "to_class", F.col("used_places").alias("consumed"), causes.alias("causes"), makers.alias("makers"), hist.alias("hist"), starts.alias("starts"),
        )
        if step < e.steps:  # the last step's events hang on its inputs
            rows = checkpointed(rows)
        groups.append(now.join(ahead.select("class_id"), "class_id", "left_semi").select(F.lit(step).alias("step"), "class_id", first.alias("first")))
        n += counts[step - 1]
        parts.append(rows.drop("makers", "hist", "starts"))
        now = rows.select(F.col("output_state").alias("state_id"), "root", F.col("to_class").alias("class_id"), "makers", "hist", "starts")
    return Replay(Evolution._all(parts), Evolution._all(groups), checkpointed(pairs), n, e.n_roots, e.steps)
