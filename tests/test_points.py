"""Rows with many points, and with one."""

import random

import pytest
from pyspark.sql import functions as F

from cellweave.functions import geohash as g
from cellweave.operators import cells as c
from cellweave.sources.points import point


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("level", [0, 1, 2, 5, 12])
def test_runs_of_many_points_against_plain_python(spark, level):
    rng = random.Random(level)
    rows = [(i, [(rng.choice([48.8, 48.80001, -33.0, 90.0, rng.uniform(-95, 95)]), rng.choice([2.3, -2.3, 180.0, 190.0, rng.uniform(-200, 200)])) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 7, 3000])]
    df = spark.createDataFrame(rows, "id long, points array<struct<lat:double,lon:double>>")
    located = c.located(df, "points", level).select("id", "__cell", "__lat", "__lon")
    # the array is put in order once: a filter that makes it anew for each point took minutes for such a row
    assert optimized(located).count("sort_array(") + optimized(located).count("array_sort(") == 1
    single = df.select("id", F.explode("points").alias("p")).withColumns({"y": g.quantise_lat(F.col("p.lat")), "x": F.shiftright(F.shiftleft(g.quantise_lon(F.col("p.lon")), 32), 32)})
    points = {}
    for r in single.withColumn("cell", g.cell(F.col("y"), F.col("x"), level)).collect():
        points.setdefault(r.id, []).append((r.y, r.x % (1 << 32), r.x, r.cell))
    want = []
    for i, many in points.items():
        many.sort()
        want += [(i, k, y, x) for n, (y, _, x, k) in enumerate(many) if n == 0 or many[n - 1][3] != k]
    assert sorted(map(tuple, located.collect())) == sorted(want)


def test_what_stands_in_for_no_points(spark):
    df = spark.createDataFrame([(1, [(10.0, 20.0)]), (2, []), (3, None), (4, [None])], "id long, points array<struct<lat:double,lon:double>>")
    count = lambda **more: sorted(r.id for r in c.located(df, "points", 5, **more).collect())
    assert count() == [1] and count(missing=[0, 0]) == [1, 2, 3, 4]


def test_one_point_a_row_takes_no_array(spark):
    df = spark.range(9).select("id", F.struct((F.col("id") * 9.5).alias("lat"), (F.col("id") * 20.5).alias("lon")).alias("p"), F.concat(F.col("id") * 9.5, F.lit(","), F.col("id") * 20.5).alias("t"))
    want = sorted(map(tuple, c.located(df.withColumn("many", F.array("p")), "many", 6).select("id", "__cell", "__lat", "__lon").collect()))
    for field in ("p", "t"):
        located = c.located(df, field, 6).select("id", "__cell", "__lat", "__lon")
        assert "Generate" not in optimized(located) and sorted(map(tuple, located.collect())) == want


def test_join_on_the_cell_tests_little_in_each_row(spark):
    """A filter that repeats the point's expressions over and over came to over 8,000 bytes of code, which isn't compiled further."""
    lat, lon = ((F.col("id") * n % 1000).cast("double") / 1e1 - 5e1 for n in (40503, 2654435))
    df = spark.range(9).select("id", lat.alias("lat"), lon.alias("lon")).withColumn("p", F.struct("lat", "lon")).withColumn("n", point(F.col("lat"), F.col("lon")))
    spark.conf.set("spark.sql.maxPlanStringLength", 10_000_000)
    clusters = spark.createDataFrame([(0, 1)], "member long, rank long")
    for located in (c.located(df, "p", 3), c.located(df, "n", 3), c.located_columns(df, "lat", "lon", 3)):
        assert not located.schema["__cell"].nullable
        plan = optimized(located.join(clusters, F.col("__cell") == F.col("member")).groupBy("rank").agg(F.count_distinct("id")))
        assert sum(line.count("isnotnull(") for line in plan.splitlines() if "Filter" in line) <= 12


def test_half_points_and_other_numbers(spark):
    df = spark.createDataFrame([(1, (None, 2)), (2, (3, None)), (3, None), (4, (3, 2))], "id long, p struct<lat:int,lon:int>")
    assert [r.id for r in c.located(df, "p", 4).collect()] == [4]
    assert sorted(r.id for r in c.located(df, "p", 4, missing=F.struct(F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon"))).collect()) == [1, 2, 3, 4]
    assert [r.id for r in c.located(df, "p", 4, missing=F.struct(F.lit(None).cast("double").alias("lat"), F.lit(1.0).alias("lon"))).collect()] == [4]
