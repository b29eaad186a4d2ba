"""Lattices and clouds as DataFrames of directed edges (src, dst), from ranges and arithmetic.

Vertices are numbered from 1, a lattice's by (i - 1) * height + j.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.functions import uniform
from braidwork.operators.relations import checkpointed

#: Events of one slice of a sprinkling, about.
SLICE = 4096


def cells(spark: SparkSession, width: int, height: int) -> DataFrame:
    """i in 1..width, j in 1..height and the vertex v."""
    v = F.col("id")
    return spark.range(1, width * height + 1).select((F.floor((v - 1) / height) + 1).alias("i"), ((v - 1) % height + 1).alias("j"), v.alias("v"))


def _links(rows: DataFrame, links: list[tuple[Column, Column]]) -> DataFrame:
    """links: (condition, target) for each cell."""
    options = F.array(*(F.when(c, t.cast("long")) for c, t in links))
    return rows.select(F.col("v").alias("src"), F.explode(F.filter(options, lambda x: x.isNotNull())).alias("dst"))


def directed(edges: DataFrame, seed: int, p: float = 0.5) -> DataFrame:
    """Turn each edge round with probability p, by a hash of the edge."""
    turn = uniform(seed, F.col("src"), F.col("dst")) < p
    return edges.select(F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("dst"))


def grid(spark: SparkSession, width: int, height: int, diagonals: bool = False) -> DataFrame:
    i, j, v, h = F.col("i"), F.col("j"), F.col("v"), height
    links = [(i < width, v + h), (j < height, v + 1)]
    if diagonals:
        links += [((i < width) & (j < height), v + h + 1), ((i < width) & (j > 1), v + h - 1)]
    return _links(cells(spark, width, height), links)


def grid_with_holes(spark: SparkSession, width: int, height: int, holes: list[tuple[float, float, float]], diagonals: bool = False) -> DataFrame:
    """Without vertices strictly inside a hole (x, y, radius) and edges whose middle is; vertices are numbered anew in order.

    Vertex (i, j) lies at (i - 1, j - 1).
    """
    from pyspark.sql import Window

    def free(x: Column, y: Column) -> Column:
        out = F.lit(True)
        for a, b, r in holes:
            out = out & ((x - a) * (x - a) + (y - b) * (y - b) >= r * r)
        return out

    i, j, v = F.col("i"), F.col("j"), F.col("v")
    kept = cells(spark, width, height).where(free(i - 1, j - 1))
    # Numbers by column of cells, so that no window spans the grid.
    counts = kept.groupBy("i").agg(F.count("*").alias("n"))
    base = counts.select("i", F.coalesce(F.sum("n").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    names = kept.join(base, "i").select("i", "j", "v", (F.col("base") + F.row_number().over(Window.partitionBy("i").orderBy("j"))).alias("name"))
    links = [(i < width, v + height, i - 0.5, j - 1), (j < height, v + 1, i - 1, j - 0.5)]
    if diagonals:
        links += [((i < width) & (j < height), v + height + 1, i - 0.5, j - 0.5), ((i < width) & (j > 1), v + height - 1, i - 0.5, j - 1.5)]
    raw = _links(kept, [(ok & free(x, y), to) for ok, to, x, y in links])
    a, b = (names.select(F.col("v").alias(c), F.col("name").alias(f"_{c}")) for c in ("src", "dst"))
    return raw.join(a, "src").join(b, "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))


def cylinder(spark: SparkSession, resolution: int, height: int) -> DataFrame:
    i, j, v = F.col("i"), F.col("j"), F.col("v")
    return _links(cells(spark, resolution, height), [(F.lit(True), (i % resolution) * height + j), (j < height, v + 1)])


def torus(spark: SparkSession, resolution: int) -> DataFrame:
    n, i, j = resolution, F.col("i"), F.col("j")
    return _links(cells(spark, n, n), [(F.lit(True), (i % n) * n + j), (F.lit(True), (i - 1) * n + j % n + 1)])


def klein_bottle(spark: SparkSession, resolution: int, height: int) -> DataFrame:
    """The first direction closes with the second turned round."""
    i, j, v, h = F.col("i"), F.col("j"), F.col("v"), height
    return _links(cells(spark, resolution, h), [(F.lit(True), F.when(i < resolution, v + h).otherwise(h - j + 1)), (j < h, v + 1)])


def moebius_strip(spark: SparkSession, resolution: int, width: int = 5) -> DataFrame:
    return klein_bottle(spark, resolution, width)


def rings(resolution: int) -> list[int]:
    """Vertices of a sphere's rings of latitude; halves are rounded to even."""
    return [max(1, round(2 * resolution * math.sin(math.pi * (k - 0.5) / resolution))) for k in range(1, resolution + 1)]


def sphere(spark: SparkSession, resolution: int) -> DataFrame:
    """Each ring is closed, and each vertex linked to the nearest longitude of the next ring."""
    sizes = rings(resolution)
    starts = np.cumsum([0, *sizes]).tolist()
    rows = spark.createDataFrame([(k, n, starts[k], sizes[k + 1] if k + 1 < len(sizes) else 0) for k, n in enumerate(sizes)], "ring int, n int, start long, next int")
    at = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).withColumn("v", F.col("start") + F.col("k") + 1)
    around = F.col("start") + (F.col("k") + 1) % F.col("n") + 1
    up = F.col("start") + F.col("n") + F.least(F.bround(F.col("k") * F.col("next") / F.col("n")).cast("long") + 1, F.col("next").cast("long"))
    return _links(at, [(F.lit(True), around), (F.col("next") > 0, up)])


def near_pairs(points: DataFrame, radius: float) -> DataFrame:
    """(src, dst) of points (id, x, y) with src < dst and a distance under radius, found by square tiles of that side."""
    tile = points.select("id", "x", "y", F.floor(F.col("x") / radius).alias("tx"), F.floor(F.col("y") / radius).alias("ty"))
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    other = tile.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), "tx", "ty", F.explode(steps).alias("s"))
    other = other.select("id2", "x2", "y2", (F.col("tx") + F.col("s.a")).alias("tx"), (F.col("ty") + F.col("s.b")).alias("ty"))
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    return tile.join(other, ["tx", "ty"]).where((F.col("id") < F.col("id2")) & (dx * dx + dy * dy < radius * radius)).select(F.col("id").alias("src"), F.col("id2").alias("dst"))


def _inside(t: Column, x: Column, t2: Column, x2: Column, speed: float, cutoff: float) -> Column:
    """Whether (t2, x2) is inside the light cone of (t, x), within the cutoff."""
    dt, dx = t2 - t, x2 - x
    tau2 = dt * dt - dx * dx / (speed * speed)
    ok = (dt > 0) & (tau2 > 0)
    return ok & (tau2 <= cutoff * cutoff) if math.isfinite(cutoff) else ok


def light_cone(points: DataFrame, speed: float = 1.0, cutoff: float = float("inf"), tiles: int = 16, reduce: bool = False) -> DataFrame:
    """(src, dst) of events (id, t, x): dst is later, inside src's light cone, and its proper time is within the cutoff.

    Along u = t + x / speed and v = t - x / speed a cone is a quadrant. Places are put into square tiles of that plane and
    joined with the tiles that the quadrant, and the cutoff, can reach (and one before, for rounding). Events of one place have
    the same links, so that places are linked once, and links dealt out by their later end before they are spelled out for events.
    reduce leaves out links that one event in between joins, which is seen in its place: what is between isn't listed.
    Events without t or x have no links.
    """
    whole = points.where("t IS NOT NULL AND x IS NOT NULL").groupBy("t", "x").agg(F.min("id").alias("id"), F.collect_list("id").alias("ids"))
    whole = checkpointed(whole)
    s = whole.select("id", "t", "x", (F.col("t") + F.col("x") / speed).alias("u"), (F.col("t") - F.col("x") / speed).alias("v"))
    box = s.agg(F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1")).first()
    if box.u0 is None:
        return s.select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0)
    side = max(box.u1 - box.u0, box.v1 - box.v0) / tiles or 1.0
    s = s.select("id", "t", "x", F.floor((F.col("u") - box.u0) / side).cast("int").alias("a"), F.floor((F.col("v") - box.v0) / side).cast("int").alias("b"))
    o = s.select(F.col("id").alias("id2"), F.col("t").alias("t2"), F.col("x").alias("x2"), "a", "b")
    reach = s.select("id", "t", "x", "b", F.col("a").alias("a0"), F.explode(F.sequence(F.col("a") - 1, F.lit(tiles))).alias("a"))
    reach = reach.select("id", "t", "x", "a0", "a", F.col("b").alias("b0"), F.explode(F.sequence(F.col("b") - 1, F.lit(tiles))).alias("b"))
    if math.isfinite(cutoff):
        p, q = (F.greatest(F.col(n) - F.col(f"{n}0") - 1, F.lit(0)) for n in ("a", "b"))
        reach = reach.where(p * q * (side * side) <= cutoff * cutoff * (1 + 1e-9))
    pairs = reach.join(o, ["a", "b"]).where(_inside(F.col("t"), F.col("x"), F.col("t2"), F.col("x2"), speed, cutoff)).select("id", "id2", "t2", "x2")
    if reduce:
        pairs = checkpointed(pairs)
        between = pairs.select(F.col("id").alias("_id"), F.col("t2").alias("_t"), F.col("x2").alias("_x")).hint("merge")
        pairs = pairs.join(between, (F.col("id") == F.col("_id")) & _inside(F.col("_t"), F.col("_x"), F.col("t2"), F.col("x2"), speed, cutoff), "left_anti")
    ids = whole.select("id", "ids").hint("merge")
    pairs = pairs.select("id", "id2").join(ids.withColumnRenamed("ids", "_src"), "id")
    pairs = pairs.join(ids.select(F.col("id").alias("id2"), F.col("ids").alias("_dst")).hint("merge"), "id2")
    return pairs.select(F.explode("_src").alias("src"), "_dst").select("src", F.explode("_dst").alias("dst"))


def without_shortcuts(pairs: DataFrame) -> DataFrame:
    """Pairs that no single vertex in between joins."""
    two = pairs.select("src", F.col("dst").alias("m")).join(pairs.select(F.col("src").alias("m"), "dst"), "m").select("src", "dst")
    return pairs.join(two, ["src", "dst"], "left_anti")


def sprinkled(spark: SparkSession, n: int, seed: int = 1, extent: float = 1.0) -> DataFrame:
    """n events (id by order of t, t, x) that depend on the seed alone; numbers come from counts of slices of t."""
    from braidwork.plans.evolve import numbered

    rows = spark.range(n).select(F.col("id").alias("_i"), uniform(seed, F.lit("t"), F.col("id")).alias("t"), (uniform(seed, F.lit("x"), F.col("id")) * 2 * extent - extent).alias("x"))
    sliced = rows.withColumn("_slice", F.floor(F.col("t") * max(1, n // SLICE)))
    return numbered(sliced, [F.col("t"), F.col("_i")], 1, "id", "_slice").select("id", "t", "x")


def first_links(pairs: DataFrame, most: int) -> DataFrame:
    """The first `most` links of each vertex, by the other end."""
    from pyspark.sql import Window

    return pairs.withColumn("_k", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("_k") <= most).drop("_k")


def minkowski(spark: SparkSession, n: int, seed: int = 1, speed: float = 1.0, cutoff: float = float("inf"), reduce: bool = True, most_links: int = 0) -> tuple[DataFrame, DataFrame]:
    """Sprinkled events and their causal links."""
    points = sprinkled(spark, n, seed)
    pairs = light_cone(points, speed, cutoff, reduce=reduce)
    return points, first_links(pairs, most_links) if most_links > 0 else pairs


def uniform_cloud(spark: SparkSession, n: int, seed: int = 1, side: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Points (id, x, y) and their links below 1.5 * sqrt(area / n)."""
    points = spark.range(n).select((F.col("id") + 1).alias("id"), (uniform(seed, F.lit("x"), F.col("id")) * side).alias("x"), (uniform(seed, F.lit("y"), F.col("id")) * side).alias("y"))
    return points, near_pairs(points, 1.5 * math.sqrt(side * side / max(n, 1)))


def poisson_disk(spark: SparkSession, n: int, distance: float, seed: int = 1, side: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Up to n points no nearer than distance, thrown one by one (100 n throws at most), and links below twice that.

    Each throw depends on all before it, so points are thrown on the driver, with a grid of cells to look them up by.
    """
    rng, taken, points = np.random.default_rng(seed), {}, []
    cell = distance / math.sqrt(2)
    for _ in range(100 * n):
        if len(points) >= n:
            break
        x, y = (rng.random(2) * side).tolist()
        a, b = int(x / cell), int(y / cell)
        near = (taken.get((a + p, b + q)) for p in range(-2, 3) for q in range(-2, 3))
        if all(o is None or math.dist((x, y), o) >= distance for o in near):
            taken[a, b] = (x, y)
            points.append((len(points) + 1, x, y))
    df = spark.createDataFrame(points, "id long, x double, y double")
    return df, near_pairs(df, 2 * distance)


def brill_lindquist(spark: SparkSession, n: int, masses: tuple[float, float], separation: float, threshold: float, seed: int = 1, box: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Points kept with probability psi**4 / 100 outside two horizons, and links whose middle is outside them too."""

    def distance(x: Column, y: Column, k: int) -> Column:
        at = (0.5 - k) * separation
        return F.sqrt((x - at) * (x - at) + y * y)

    def outside(x: Column, y: Column) -> Column:
        return (distance(x, y, 0) >= masses[0] / 2) & (distance(x, y, 1) >= masses[1] / 2)

    x, y = F.col("x"), F.col("y")
    tries = spark.range(1000 * n).select("id", (uniform(seed, F.lit("x"), F.col("id")) * 2 * box - box).alias("x"), (uniform(seed, F.lit("y"), F.col("id")) * 2 * box - box).alias("y"))
    psi = 1 + masses[0] / (2 * F.greatest(distance(x, y, 0), F.lit(0.001))) + masses[1] / (2 * F.greatest(distance(x, y, 1), F.lit(0.001)))
    kept = tries.where(outside(x, y) & (uniform(seed, F.lit("keep"), F.col("id")) < F.pow(psi, 4) / 100)).orderBy("id").limit(n)
    pairs = near_pairs(kept, threshold)
    a, b = (kept.select(F.col("id").alias(c), F.col("x").alias(f"{c}_x"), F.col("y").alias(f"{c}_y")) for c in ("src", "dst"))
    middle = outside((F.col("src_x") + F.col("dst_x")) / 2, (F.col("src_y") + F.col("dst_y")) / 2)
    return kept, pairs.join(a, "src").join(b, "dst").where(middle).select("src", "dst")


GENERATORS = {"Grid": grid, "GridWithHoles": grid_with_holes, "Cylinder": cylinder, "Torus": torus, "Sphere": sphere, "KleinBottle": klein_bottle, "MobiusStrip": moebius_strip}


CLOUDS = {"MinkowskiSprinkling": minkowski, "BrillLindquist": brill_lindquist, "PoissonDisk": poisson_disk, "UniformRandom": uniform_cloud}


def generate(spark: SparkSession, kind: str, **how: object) -> DataFrame:
    """Edges (src, dst) of a lattice, or of a cloud's links."""
    if kind in CLOUDS:
        return CLOUDS[kind](spark, **how)[1]
    if kind not in GENERATORS:
        raise ValueError(f"unknown initial condition {kind}")
    return GENERATORS[kind](spark, **how)


def one_state(edges: DataFrame) -> DataFrame:
    """A root (root, verts) of all edges (src, dst), in their order. For lattices that fit a row; see operators.match.exploded for others."""
    rows = edges.agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("e"))
    return rows.select(F.lit(0).cast("long").alias("root"), F.transform("e", lambda e: F.array(e["src"], e["dst"])).alias("verts"))
