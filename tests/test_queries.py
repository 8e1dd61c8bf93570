"""Every registered query of the library against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from scholargraph.operators.components import connected_components
from scholargraph.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda x: "NULL" if x is None or x != x else str(int(x)) if isinstance(x, float) and x.is_integer() else str(round(x, 9) if isinstance(x, float) else x)
    return sorted("|".join(show(r[i]) for i in order) for r in data)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables are not here")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(5, 5)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 40)}}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
