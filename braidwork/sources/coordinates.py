"""Where a lattice's vertices lie: (v, x, y) on the flat sheet, and px, py, pz in space where the lattice has such a place."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.sources.generators import cells, rings

#: Default radii of curved lattices (fixed values).
RADIUS, TUBE = 10.0, 3.0


def _angle(index: Column, n: int | Column) -> Column:
    return (index - 1) * (2 * math.pi) / n


def _placed(rows: DataFrame, x: Column, y: Column, space: tuple[Column, Column, Column] | None = None) -> DataFrame:
    space = space or (F.lit(None).cast("double"),) * 3
    return rows.select("v", x.cast("double").alias("x"), y.cast("double").alias("y"), *(p.cast("double").alias(n) for p, n in zip(space, ("px", "py", "pz"), strict=True)))


def _around(distance: Column, angle: Column, up: Column) -> tuple[Column, Column, Column]:
    return distance * F.cos(angle), distance * F.sin(angle), up


def grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    return _placed(cells(spark, width, height), F.col("i") - 1, F.col("j") - 1)


def cylinder(spark: SparkSession, resolution: int, height: int, radius: float = RADIUS) -> DataFrame:
    turn, up = _angle(F.col("i"), resolution), F.col("j") - 1
    return _placed(cells(spark, resolution, height), turn, up, _around(F.lit(radius), turn, up))


def torus(spark: SparkSession, resolution: int, radius: float = RADIUS, tube: float = TUBE) -> DataFrame:
    turn, roll = _angle(F.col("i"), resolution), _angle(F.col("j"), resolution)
    return _placed(cells(spark, resolution, resolution), turn, roll, _around(radius + tube * F.cos(roll), turn, tube * F.sin(roll)))


def sphere(spark: SparkSession, resolution: int, radius: float = RADIUS) -> DataFrame:
    """Flat places are (polar angle, longitude)."""
    sizes = rings(resolution)
    rows = spark.createDataFrame([(k + 1, n, sum(sizes[:k])) for k, n in enumerate(sizes)], "i int, n int, start long")
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("j")).withColumn("v", F.col("start") + F.col("j"))
    polar, turn = (F.col("i") - 0.5) * math.pi / resolution, _angle(F.col("j"), F.col("n"))
    return _placed(rows, polar, turn, _around(radius * F.sin(polar), turn, radius * F.cos(polar)))


def klein_bottle(spark: SparkSession, resolution: int, height: int, radius: float = RADIUS) -> DataFrame:
    """A Klein bottle has no place in space without crossing itself: flat places alone."""
    return _placed(cells(spark, resolution, height), radius * _angle(F.col("i"), resolution), F.col("j") - 1)


def moebius_strip(spark: SparkSession, resolution: int, width: int = 5, radius: float = RADIUS) -> DataFrame:
    """A strip one wide that turns by half; one of a single line lies on its middle."""
    turn = _angle(F.col("i"), resolution)
    across = (F.col("j") - 1) / (width - 1) - 0.5 if width > 1 else F.lit(0.0)
    return _placed(cells(spark, resolution, width), radius * turn, across * radius, _around(radius + across * F.cos(turn / 2), turn, across * F.sin(turn / 2)))


PLACES: dict[str, Callable[..., DataFrame]] = {"Grid": grid, "Cylinder": cylinder, "Torus": torus, "Sphere": sphere, "KleinBottle": klein_bottle, "MobiusStrip": moebius_strip}


def coordinates(spark: SparkSession, kind: str, **how: object) -> DataFrame:
    if kind not in PLACES:
        raise ValueError(f"no coordinates for {kind}")
    return PLACES[kind](spark, **how)
