"""Every registered query of the engine against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from braidwork import catalog
from braidwork.sources import generators

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted(str(tuple(r[c] for c in names)) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql:
        found = duck.execute(sql)
        at = [[d[0] for d in found.description].index(c) for c in names]
        assert rows == sorted(str(tuple(r[i] for i in at)) for r in found.fetchall())


def test_clouds(spark):
    for points, links in (
        generators.uniform_cloud(spark, 200),
        generators.poisson_disk(spark, 60, 0.05),
        generators.brill_lindquist(spark, 80, (1.0, 2.0), 4.0, 2.0),
        generators.minkowski(spark, 80, cutoff=0.5, most_links=3),
    ):
        ids = {r.id for r in points.collect()}
        pairs = links.collect()
        assert pairs and all(r.src in ids and r.dst in ids and r.src != r.dst for r in pairs)
    turned = generators.directed(generators.grid(spark, 20, 20), seed=3)
    flips = turned.where("src > dst").count()
    assert turned.count() == 760 and 280 < flips < 480
    assert generators.one_state(generators.generate(spark, "Torus", resolution=4)).first().verts[0] == [1, 2]
    with pytest.raises(ValueError):
        generators.generate(spark, "Nowhere")
