"""Every query with SQL against DuckDB, and the micro-cases of the rules."""

import glob
import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from cartulary.operators import hierarchy, seats, territory
from cartulary.plans import catalogue, derived, pages, recipes, scraped

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = [tuple(None if pd.isna(x) else float(x) if isinstance(x, numbers.Number) and not isinstance(x, (bool, np.bool_)) else str(x) for x in r) for r in frame.itertuples(index=False)]
    return list(frame.columns), sorted(clean, key=str)


PLANS = (catalogue, derived, pages, recipes, scraped)
QUERIES, ORACLES = ({k: v for plan in PLANS for k, v in getattr(plan, kind).items()} for kind in ("QUERIES", "ORACLES"))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = rows(QUERIES[name](spark, SF).toPandas())
    want = rows(duck.sql(ORACLES[name]).df())
    assert got[0] == want[0] and got[1] == want[1]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.fixture(scope="module")
def micro(spark):
    data = [("x", 0, None, 460, None), ("x_A", 1, "x", 410, "30.00"), ("x_B", 1, "x", 50, None), ("x_A1", 2, "x_A", 100, "10.00"), ("x_A2", 2, "x_A", 300, "20.00"), ("x_B1", 2, "x_B", None, "5.00"), ("x_B2", 2, "x_B", 50, None)]
    return spark.createDataFrame(data, "id string, level int, parent_id string, pop_latest long, a string").selectExpr("*", "CAST(a AS decimal(12,2)) AS area_km2")


@pytest.mark.parametrize(("legal", "want"), [(None, {"x": "x_A2", "x_A": "x_A2", "x_B": "x_B2"}), (1, {"x": "x_A", "x_A": "x_A2", "x_B": "x_B2"})])
def test_most_populated(micro, legal, want):
    assert {r.id: r.most_populated for r in hierarchy.most_populated(micro, legal).collect()} == want


def test_territory(spark, micro):
    spec = spark.createDataFrame([("t", "x_A", "include"), ("t", "x_B2", "include"), ("t", "x_A1", "subtract"), ("u", "x_A", "include"), ("u", "x_A1", "include")], "territory string, id string, sign string")
    held = {(r.territory, r.node) for r in territory.members(spec, micro, 2).collect()}
    assert held == {("t", "x_A2"), ("t", "x_B2"), ("u", "x_A1"), ("u", "x_A2")}
    sums = {r.territory: r for r in territory.totals(spec, micro, 2).collect()}
    assert (sums["t"]["pop"], float(sums["t"]["area"]), sums["t"]["density"], sums["u"]["pop"]) == (360, 20.0, 18.0, 510)


@pytest.mark.parametrize(("total", "high", "want"), [(10, None, [2, 6, 1, 1]), (9, None, [2, 5, 1, 1]), (10, 3, [4, 3, 1, 2])])
def test_dhondt(micro, total, high, want):
    from pyspark.sql import functions as F

    leaves = micro.where("level = 2").selectExpr("'g' AS g", "id AS code", "pop_latest")
    most = F.when(F.col("code") == "x_A2", high).cast("int") if high else None
    assert [r.seats for r in seats.dhondt(leaves, "g", F.lit(total), F.lit(1), most).orderBy("code").collect()] == want
    with pytest.raises(Exception, match="minima exceed"):
        seats.dhondt(leaves, "g", F.lit(3), F.lit(1)).collect()


def test_texts(spark):
    from pyspark.sql import functions as F

    from cartulary.functions import text

    numbers = {"1,234": 1234, "1,23": 1.23, "1.234,5": 1234.5, "1,234.5": 1234.5, "1.234": 1.234, "1.234.567": None, "-": None, "12 km²": 12}
    df = spark.createDataFrame([(k,) for k in numbers], "t string")
    assert {r.t: r.v for r in df.select("t", text.locale_number(F.col("t")).alias("v")).collect()} == numbers
    one = spark.range(1).select(text.normalised(F.lit("  Málaga   Ciudad ")).alias("a"), text.slug(F.lit("Aragón (Alto)")).alias("b"), text.year(F.lit("census 1998")).alias("c")).first()
    assert tuple(one) == ("malaga ciudad", "aragon-alto", 1998)


def test_parent_stack(spark):
    levels = spark.createDataFrame([(1, i, v) for i, v in enumerate([0, 1, 2, 2, 1, 2, 0, 2])], "p int, o long, level int")
    assert [r.parent for r in hierarchy.parent_by_stack(levels, "p", "o", "level").orderBy("o").collect()] == [None, 0, 1, 1, 0, 4, None, None]


def test_bench_names():
    import bench

    assert set(bench.HEADLINE) <= set(catalogue.QUERIES)
