"""Relations between events: causal, branchial, reachability and transitive reduction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.operators.match import Codes


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to spark.checkpoint.dir and read back, which cuts its lineage."""
    import atexit
    import shutil
    import tempfile

    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_braidwork_dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        own = tempfile.mkdtemp(prefix="braidwork-")
        atexit.register(shutil.rmtree, own, True)
        folder = spark._braidwork_dir = f"file://{own}"
    path = f"{folder.rstrip('/')}/braidwork-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def causal_triples(consumed: DataFrame, created: DataFrame) -> DataFrame:
    """(producer, consumer, edge_id) of an event's consumed edge that another created.

    consumed: event_id, edge_id; created: creator, edge_id.
    """
    made = created.where("creator IS NOT NULL").select(F.col("creator").alias("producer"), "edge_id")
    return consumed.join(made, "edge_id").select("producer", F.col("event_id").alias("consumer"), "edge_id")


def causal_pairs(triples: DataFrame) -> DataFrame:
    return triples.select("producer", "consumer").distinct()


def caused(events: DataFrame, reduce: bool = True, genesis: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(producer, consumer), each pair once, and the consumer's columns keep; nothing is shuffled: all causes of an event lie in its row.

    events: event_id, root, consumed, causes. genesis adds what events consume of their root, made by event -1 - root;
    reduced, an event has that link only where it has no other cause.
    """
    causes = F.filter("causes", lambda c: c["kept"]) if reduce else F.col("causes")
    makers = F.array_distinct(causes["producer"])
    if genesis:
        made = F.transform("causes", lambda c: c["edge_id"])
        of_root = F.size("causes") == 0 if reduce else F.size(F.array_except("consumed", made)) > 0
        makers = F.when(of_root, F.concat(F.array(-1 - F.col("root")), makers)).otherwise(makers)
    return events.select(F.explode(makers).alias("producer"), F.col("event_id").alias("consumer"), *keep)


def caused_edges(events: DataFrame) -> DataFrame:
    """(producer, consumer, edges, kept): each causal pair with how many edges it shares and whether no longer path joins it; nothing is shuffled.

    events: event_id, causes. All edges of a pair were made at one depth, and so are kept alike.
    """
    pairs = F.array_distinct(F.transform("causes", lambda c: F.struct(c["producer"].alias("producer"), c["kept"].alias("kept"))))
    shared = F.transform(pairs, lambda p: F.struct(p["producer"].alias("producer"), F.size(F.filter("causes", lambda c: c["producer"] == p["producer"])).cast("long").alias("edges"), p["kept"].alias("kept")))
    return events.select(F.col("event_id").alias("consumer"), F.explode(shared).alias("p")).select("p.producer", "consumer", "p.edges", "p.kept")


def branchial_triples(consumed: DataFrame) -> DataFrame:
    """(event1 < event2, shared_edge): a row for each edge of one input state that both events consume.

    consumed: event_id, input_state, edge_id.
    """
    a = consumed.select("input_state", "edge_id", F.col("event_id").alias("event1"))
    b = consumed.select("input_state", "edge_id", F.col("event_id").alias("event2"))
    return a.join(b, ["input_state", "edge_id"]).where("event1 < event2").select("event1", "event2", F.col("edge_id").alias("shared_edge"))


def branchial_pairs(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row of branchial_triples for each pair, with the least shared edge; a pair is kept where it meets on that edge, so that pairs aren't shuffled.

    events: event_id, input_state, consumed (the edges' ids); keep: more columns, of the first event.
    """
    rows = events.select("input_state", "event_id", "consumed", *keep, F.explode("consumed").alias("edge_id"))
    a = rows.select("input_state", "edge_id", F.col("event_id").alias("event1"), F.col("consumed").alias("_c1"), *keep)
    b = rows.select("input_state", "edge_id", F.col("event_id").alias("event2"), F.col("consumed").alias("_c2"))
    least = F.array_min(F.array_intersect("_c1", "_c2"))
    met = a.join(b, ["input_state", "edge_id"]).where("event1 < event2").where(F.col("edge_id") == least)
    return met.select("event1", "event2", F.col("edge_id").alias("shared_edge"), *keep)


def branchial_within(groups: DataFrame, codes: Codes, keep: tuple[str, ...] = ()) -> DataFrame:
    """branchial_pairs, and the columns keep, from rows that hold all events of an input state; nothing is shuffled.

    groups: first (number of the first event), codes (its events in order), edges.
    """
    one = groups.where(F.size("codes") > 1).select("first", "codes", "edges", *keep, F.posexplode("codes").alias("_a", "_ca"))
    two = one.select("first", "edges", *keep, "_a", "_ca", F.posexplode("codes").alias("_b", "_cb")).where("_a < _b")
    met = two.withColumn("_place", codes.shared(F.col("_ca"), F.col("_cb"))).where("_place IS NOT NULL")
    return met.select((F.col("first") + F.col("_a")).alias("event1"), (F.col("first") + F.col("_b")).alias("event2"), F.get("edges", F.col("_place"))["edge_id"].alias("shared_edge"), *keep)


def indexed(triples: DataFrame, src: str, dst: str, edge: str) -> DataFrame:
    """triples with edge_index, which numbers the edges of one pair from 0."""
    from pyspark.sql import Window

    return triples.withColumn("edge_index", F.row_number().over(Window.partitionBy(src, dst).orderBy(edge)) - 1)


def branchial_cliques(consumed: DataFrame) -> DataFrame:
    """Number of events by (input_state, edge_id): the cliques that the branchial pairs come from, without making the pairs."""
    return consumed.groupBy("input_state", "edge_id").agg(F.count("*").alias("events"))


def cliques_within(groups: DataFrame, codes: Codes) -> DataFrame:
    """input_state, edges, most: how many edges a state's events consume, and how many events the commonest; nothing is shuffled. groups: see branchial_within."""
    rows = groups.where(F.size("codes") > 0).select("input_state", F.flatten(F.transform("codes", codes.places_of)).alias("_p"))
    rows = rows.withColumn("_d", F.array_distinct("_p"))
    most = F.array_max(F.transform("_d", lambda x: F.size(F.filter("_p", lambda y: y == x))))
    return rows.select("input_state", F.size("_d").cast("long").alias("edges"), most.cast("long").alias("most"))


def siblings(events: DataFrame, step: int | None = None) -> DataFrame:
    """All pairs of output states of one input state, whether their events overlap or not; of all steps or of one."""
    events = events if step is None else events.where(F.col("step") == step)
    a = events.select("input_state", F.col("event_id").alias("_a"), F.col("output_state").alias("state1"))
    b = events.select("input_state", F.col("event_id").alias("_b"), F.col("output_state").alias("state2"))
    return a.join(b, "input_state").where("_a < _b").select("state1", "state2")


def reachability(pairs: DataFrame) -> DataFrame:
    """(src, dst) joined by a path of at least one step, by doubling the path length until nothing is new."""
    now = checkpointed(pairs.select("src", "dst").distinct())
    while True:
        step = now.select("src", F.col("dst").alias("_m")).join(now.select(F.col("src").alias("_m"), "dst"), "_m").select("src", "dst")
        new = checkpointed(step.join(now, ["src", "dst"], "left_anti").distinct())
        if new.isEmpty():
            return now
        now = checkpointed(now.unionByName(new))


def reduced(pairs: DataFrame) -> DataFrame:
    """Transitive reduction of a DAG (src, dst): pairs that no longer path joins."""
    pairs = pairs.select("src", "dst").distinct()
    reach = reachability(pairs)
    longer = pairs.select("src", F.col("dst").alias("_m")).join(reach.select(F.col("src").alias("_m"), "dst"), "_m").select("src", "dst")
    return pairs.join(longer, ["src", "dst"], "left_anti")


def branchial_step(step: int, steps: int) -> int | None:
    """The step that a BranchialStep option means: 0 all (None), k > 0 that step, k < 0 from the end (-1 the last)."""
    return None if step == 0 else step if step > 0 else steps + 1 + step
