"""Golden results and properties of clustering."""

import math
import random
import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import geohash as g
from cellweave.operators.clustering import from_request, geo_point_clustering, sampled
from cellweave.operators.merge import merge_cells
from cellweave.operators.subaggs import predicate
from cellweave.plans.params import ClusterParams
from cellweave.search import search
from cellweave.sources.points import POINT, bounding_box
from cellweave.sources.response import same_result, to_response, with_json

# fixed values: fifteen places in and around a city, as (lon, lat)
PLACES = [
    (2.454929, 48.821578), (2.245858, 48.86914), (2.240358, 48.863481), (2.25292, 48.847176), (2.279111, 48.872383),
    (2.336267, 48.822021), (2.338677, 48.822672), (2.336643, 48.822493), (2.438465, 48.84204), (2.381554, 48.835382),
    (2.407744, 48.83733), (2.34521, 48.849358), (2.252938, 48.846041), (2.279715, 48.871775), (2.380629, 48.879757),
]


@pytest.fixture(scope="module")
def places(spark):
    rows = [(i, x, y) for i, (x, y) in enumerate(PLACES, 1)]
    return spark.createDataFrame(rows, "id long, lon double, lat double").withColumn("point", F.struct("lat", "lon")).repartition(3)


def ordered(df):
    return df.orderBy("cluster_rank").collect()


def grid(spark, points, **columns):
    return spark.createDataFrame([(i, (float(a), float(b))) for i, (a, b) in enumerate(points)], "id long, point struct<lat:double,lon:double>")


@pytest.mark.parametrize("zoom,counts", [(0, [15]), (1, [15]), (9, [9, 6]), (11, [1, 2, 2, 1, 2, 1, 1, 3, 2]), (25, [1] * 15)])
def test_counts_by_zoom(places, zoom, counts):
    assert [r.doc_count for r in ordered(geo_point_clustering(places, "point", zoom=zoom))] == counts


def test_centroids(places):
    (one,) = ordered(geo_point_clustering(places, "point", zoom=1))
    assert one.centroid == pytest.approx((48.8468417795375, 2.331401154398918), abs=1e-9)
    first, second = ordered(geo_point_clustering(places, ("lat", "lon"), zoom=9))
    assert first.centroid == pytest.approx((48.83695897646248, 2.380013056099415), abs=1e-9)
    assert second.centroid == pytest.approx((48.86166598415002, 2.258483301848173), abs=1e-9)
    assert set(first.geohash_grids) == {"u09wn", "u09tz", "u09ty", "u09tx", "u09tv", "u09tt"}
    assert set(second.geohash_grids) == {"u09w5", "u09tg", "u09tf"}
    assert first.geohash_grids == sorted(first.geohash_grids, reverse=True) and first.key == "u09wn"


def test_size_limits_cells_not_clusters(places):
    (one,) = ordered(geo_point_clustering(places, "point", zoom=9, size=1))
    assert (one.key, one.doc_count) == ("u09wn", 1)


def test_bounding_box(places):
    box = places.where(bounding_box(F.col("lat"), F.col("lon"), top=48.88, left=2.23, bottom=48.84, right=2.29))
    assert [r.doc_count for r in ordered(geo_point_clustering(box, "point", zoom=9))] == [6]


def test_box_over_the_date_line(spark):
    df = grid(spark, [(0, 179.5), (0, -179.5), (0, 0), (5, 179.9)])
    inside = df.where(bounding_box(F.col("point.lat"), F.col("point.lon"), top=1, left=179, bottom=-1, right=-179))
    assert {r.id for r in inside.collect()} == {0, 1}


@pytest.mark.parametrize("form", ["array<double>", "string", "wkt"])
def test_other_forms_of_points(places, form):
    column = {"array<double>": F.array("lon", "lat"), "string": F.concat_ws(", ", "lat", "lon"), "wkt": F.concat(F.lit("POINT ("), "lon", F.lit(" "), "lat", F.lit(")"))}[form]
    assert [r.doc_count for r in ordered(geo_point_clustering(places.withColumn("p", column), "p", zoom=9))] == [9, 6]


def test_geohash_text_is_read_at_its_middle(spark):
    df = spark.createDataFrame([("u09wn",), ("not a point",), (None,)], "p string")
    (r,) = ordered(geo_point_clustering(df, "p", zoom=9))
    assert (r.key, r.doc_count) == ("u09wn", 1)


def test_partitions_do_not_matter(places):
    want = [tuple(r) for r in ordered(geo_point_clustering(places, "point", zoom=10, ratio=1.4))]
    for n in (1, 2, 8):
        assert [tuple(r) for r in ordered(geo_point_clustering(places.repartition(n), "point", zoom=10, ratio=1.4))] == want


LEVELS = {0: 1, 1: 2, 2: 2, 3: 3, 5: 3, 6: 4, 7: 4, 8: 5, 10: 5, 11: 6, 12: 6, 13: 7, 15: 7, 16: 8, 17: 8, 18: 9, 20: 9, 21: 10, 22: 10, 23: 11, 25: 11}


def test_levels():
    assert {z: ClusterParams(zoom=z).level for z in LEVELS} == LEVELS
    assert ClusterParams(zoom=0, radius=400).level == 0 and ClusterParams(zoom=25, radius=1).level == 12


@pytest.mark.parametrize("bad", [{"zoom": -1}, {"zoom": 26}, {"radius": 0}, {"extent": 0}, {"ratio": 2.1}, {"size": 0}, {"shard_size": 0}, {"zoom": "x"}, {"radius": 1.5}, {"ratio": "x"}, {"size": True}])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        ClusterParams(**bad)


def test_parameters_round_trip():
    p = ClusterParams(zoom=3, radius=50, ratio=-1, extent=512, size=7, shard_size=9)
    assert ClusterParams.from_spec(p.to_spec()) == p and hash(ClusterParams.from_spec(p.to_spec())) == hash(p)
    with pytest.raises(ValueError):
        ClusterParams.from_spec({"zom": 1})


def slow_merge(cells, radius, ratio):
    """The merge as it is told, cell by cell."""

    def far(a, b):
        p, q = math.radians(a[2]), math.radians(b[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * g.EARTH_RADIUS_METRES * math.asin(min(1, math.sqrt(h)))

    left, out = list(cells), []
    while left:
        s, edge, rest, members = list(left[0]), [], [], [left[0][0]]

        def joins(c):
            return far(s, c) <= radius * math.cos(math.radians((s[2] + c[2]) / 2))  # noqa: B023

        def join(c):
            n = s[1] + c[1]  # noqa: B023
            s[2], s[3], s[1] = (s[2] * s[1] + c[2] * c[1]) / n, (s[3] * s[1] + c[3] * c[1]) / n, n  # noqa: B023
            members.append(c[0])  # noqa: B023

        for c in left[1:]:
            if joins(c):
                join(c)
            else:
                rest.append(c)
                if ratio > 0 and far(s, c) / (radius * math.cos(math.radians((s[2] + c[2]) / 2))) < ratio:
                    edge.append(c)
        for c in edge:
            if joins(c):
                join(c)
                rest.remove(c)
        out.append((members, s[1], s[2], s[3]))
        left = rest
    return out


@pytest.mark.parametrize("seed,n,radius,ratio", [(1, 60, 8e5, 0), (2, 200, 3e5, 1.5), (3, 1031, 2e5, 2), (7, 700, 2e6, 1.3), (4, 50, 1e7, 1.2), (5, 1, 1, 0), (6, 80, 5e5, -1)])
def test_merge_matches_the_plain_one(seed, n, radius, ratio):
    rng = random.Random(seed)
    cells = [(n - i, rng.randrange(1, 50), rng.uniform(-70, 70), rng.uniform(-179, 179)) for i in range(n)]
    key, count, lat, lon = (np.array(x) for x in zip(*cells))
    cluster, total, y, x = merge_cells(count, lat, lon, radius, ratio)
    want = slow_merge(cells, radius, ratio)
    assert len(total) == len(want)
    for i, (members, m, a, b) in enumerate(want):
        assert set(key[cluster == i]) == set(members) and total[i] == m and (y[i], x[i]) == pytest.approx((a, b))


def test_every_cell_once_and_no_row_lost(places):
    rows = ordered(geo_point_clustering(places, "point", zoom=12))
    grids = [c for r in rows for c in r.geohash_grids]
    assert len(grids) == len(set(grids)) and sum(r.doc_count for r in rows) == 15
    assert all(r.key == max(r.geohash_grids) for r in rows)


def test_distance_wraps_at_the_date_line_but_the_mean_does_not(spark):
    (r,) = ordered(geo_point_clustering(grid(spark, [(0, 179.99), (0, -179.99)]), "point", zoom=9))
    assert r.doc_count == 2 and abs(r.centroid.lon) < 0.1


def test_poles_and_edges_of_the_range(spark):
    df = grid(spark, [(90, 180), (-90, -180), (90, 0), (89.99, 0)])
    rows = ordered(geo_point_clustering(df, "point", zoom=5))
    assert sum(r.doc_count for r in rows) == 4


def test_keys_of_twelve_letters_are_ordered_as_signed_numbers(spark):
    df = grid(spark, [(10, 100), (10, -100)])
    rows = ordered(geo_point_clustering(df, "point", zoom=25, radius=1))
    assert [round(r.centroid.lon) for r in rows] == [-100, 100] and len(rows[0].key) == 12


def test_one_cell_for_the_whole_world(spark):
    (r,) = ordered(geo_point_clustering(grid(spark, [(10, 100), (-10, -100)]), "point", zoom=0, radius=400))
    assert (r.key, r.geohash_grids, r.doc_count) == ("", [""], 2)


def test_nulls_are_left_out_or_stood_in_for(spark):
    rows = [(1, None), (2, (48.8, 2.3)), (3, (None, 2.3)), (4, (48.8, None))]
    df = spark.createDataFrame(rows, "id long, point struct<lat:double,lon:double>")
    assert [r.doc_count for r in ordered(geo_point_clustering(df, "point", zoom=9))] == [1]
    for missing in ([0.0, 0.0], {"lat": 0.0, "lon": 0.0}, "0,0", "s0000"):
        assert sorted(r.doc_count for r in ordered(geo_point_clustering(df, "point", zoom=9, missing=missing))) == [1, 3]
    with pytest.raises(ValueError):
        geo_point_clustering(df, "point", missing="nowhere at all")


def test_field_that_is_not_there(places):
    assert geo_point_clustering(places, "nothing").collect() == []
    assert geo_point_clustering(places, "nothing").dtypes == geo_point_clustering(places, "point").dtypes
    assert [r.doc_count for r in ordered(geo_point_clustering(places, "nothing", missing=[0, 0]))] == [15]
    with pytest.raises(ValueError):
        geo_point_clustering(places, "id")


def test_no_rows(spark, places):
    assert geo_point_clustering(places.limit(0), "point").collect() == []


def test_many_points_a_row(spark):
    a, b = (48.80, 2.30), (48.8000001, 2.3000001)
    rows = [(1, [a, b]), (2, [a]), (3, []), (4, None), (5, [(0.0, 0.0), a, None])]
    df = spark.createDataFrame(rows, "id long, points array<struct<lat:double,lon:double>>")
    assert sorted(r.doc_count for r in ordered(geo_point_clustering(df, "points", zoom=9))) == [1, 3]


def test_a_cell_counts_again_after_another(spark):
    # in order of latitude, longitude: the first and the third value share a cell, the second lies in the one to the east
    points = [(0.01, 0.01), (0.02, 46.0), (0.03, 0.01)]
    df = spark.createDataFrame([(1, points)], "id long, points array<struct<lat:double,lon:double>>")
    assert sum(r.doc_count for r in ordered(geo_point_clustering(df, "points", zoom=0, radius=1, extent=256 * 6))) == 3
    assert sum(r.doc_count for r in ordered(geo_point_clustering(df, "points", zoom=0, radius=399))) == 1


def test_groups(places):
    df = places.withColumn("half", F.col("id") % 2)
    rows = geo_point_clustering(df, "point", zoom=9, by=["half"]).collect()
    for half in (0, 1):
        alone = ordered(geo_point_clustering(df.where(F.col("half") == half), "point", zoom=9))
        assert sorted((r.cluster_rank, r.doc_count, r.key) for r in rows if r.half == half) == [(r.cluster_rank, r.doc_count, r.key) for r in alone]


def test_sub_aggregations(places):
    metrics = {"total": ("sum", "id"), "mean": ("avg", "id"), "least": ("min", "id"), "most": ("max", "id"), "n": ("count", "id")}
    rows = ordered(geo_point_clustering(places, "point", zoom=9, metrics=metrics, aggs={"odd": F.sum(F.col("id") % 2)}, terms={"kinds": ("id", 2)}))
    assert [(r.total, r.mean, r.least, r.most, r.n, r.odd) for r in rows] == [(79, 79 / 9, 1, 15, 9, 5), (41, 41 / 6, 2, 14, 6, 3)]
    assert [k.key for k in rows[1].kinds] == ["13", "14"]
    with pytest.raises(ValueError):
        geo_point_clustering(places, "point", metrics={"x": ("median", "id")})


def test_metrics_of_nulls(spark):
    df = spark.createDataFrame([((1.0, 1.0), None)], "point struct<lat:double,lon:double>, v double")
    (r,) = ordered(geo_point_clustering(df, "point", metrics={"s": ("sum", "v"), "a": ("avg", "v"), "m": ("min", "v"), "n": ("count", "v")}))
    assert (r.a, r.m, r.n, r.s) == (None, None, 0, None)


def test_too_many_buckets(places):
    assert geo_point_clustering(places, "point", zoom=9, max_buckets=2).count() == 2
    with pytest.raises(Exception, match="more than 1 buckets"):
        geo_point_clustering(places, "point", zoom=9, max_buckets=1).collect()


def test_sampling_scales_counts(spark):
    df = spark.range(20_000).select(F.struct(F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon")).alias("point"), F.lit(1.0).alias("v"))
    (r,) = ordered(geo_point_clustering(df, "point", sample=0.25, seed=3, metrics={"total": ("sum", "v")}))
    assert abs(r.doc_count - 20_000) < 1500 and abs(r.total - r.doc_count) < 4
    with pytest.raises(ValueError):
        geo_point_clustering(df, "point", sample=0)


def test_request_and_response(places):
    request = {"geo_point_clustering": {"field": "point", "zoom": 9}, "aggs": {"mean": {"avg": {"field": "id"}}, "s": {"stats": {"field": "id"}}, "d": {"cardinality": {"field": "id"}}, "p": {"percentiles": {"field": "id", "percents": [50]}}}, "meta": {"a": 1}}
    response = to_response(from_request(places, request), "c", meta=request["meta"], total=places.count())
    first, second = response["aggregations"]["c"]["buckets"]
    assert response["hits"]["total"]["value"] == 15 and response["aggregations"]["c"]["meta"] == {"a": 1}
    assert (first["doc_count"], second["mean"]["value"], first["s"]["count"], first["d"]["value"]) == (9, 41 / 6, 9, 9)
    assert set(first) == {"geohash_grids", "doc_count", "centroid", "mean", "s", "d", "p"}
    assert '"doc_count":9' in with_json(from_request(places, request)).orderBy("cluster_rank").first()["json"]
    for bad in ({"geo_point_clustering": {"zoom": 1}}, {"geo_point_clustering": {"field": "point", "x": 1}}, {"other": {}}, {"geo_point_clustering": {"field": "point"}, "aggs": {"a": {"nothing": {"field": "id"}}}}):
        with pytest.raises(ValueError):
            from_request(places, bad)


def plain_key(y, x, level):
    bits = 0
    for i in range(5 * level):
        value = (x if i % 2 == 0 else y) + (1 << 31)
        bits = bits << 1 | value >> (31 - i // 2) & 1
    key = bits << 4 | level
    return key - (1 << 64) if key >> 63 else key


def test_keys_and_packing_go_back_and_forth(spark):
    rng = random.Random(4)
    places = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)] + [(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0)]
    steps = spark.createDataFrame(places, "lat double, lon double").select(g.quantise_lat(F.col("lat")).alias("y"), g.quantise_lon(F.col("lon")).alias("x")).collect()
    assert all(r.y == min(math.floor(a / g.LAT_STEP), (1 << 31) - 1) and r.x == min(math.floor(b / g.LON_STEP), (1 << 31) - 1) for r, (a, b) in zip(steps, places))
    df = spark.createDataFrame(steps, "y long, x long")
    packed = g.pack(F.col("y"), F.col("x"))
    assert df.where((g.unpack_lat(packed) != F.col("y")) | (g.unpack_lon(packed) != F.col("x"))).count() == 0
    for level in (0, 1, 4, 5, 8, 11, 12):
        keys = [r.k for r in df.select(g.cell(F.col("y"), F.col("x"), level).alias("k")).collect()]
        assert keys == [plain_key(r.y, r.x, level) for r in steps]
        assert keys == [r.k for r in g.with_cell(df, "y", "x", level, "k").collect()]
        lat, lon = g.corner(F.col("k"), level)
        corners = spark.createDataFrame([(k,) for k in keys], "k long").select(lat.alias("lat"), lon.alias("lon"), g.geohash(F.col("k"), level).alias("text")).collect()
        high, wide = 180 / 2 ** (5 * level // 2), 360 / 2 ** ((5 * level + 1) // 2)
        assert all(c.lat <= r.y * g.LAT_STEP < c.lat + high and c.lon <= r.x * g.LON_STEP < c.lon + wide and len(c.text) == level for c, r in zip(corners, steps))


def test_schema(places):
    schema = geo_point_clustering(places, "point").schema
    assert schema["centroid"].dataType == POINT and [f.name for f in schema] == ["cluster_rank", "key", "key_point", "geohash_grids", "doc_count", "centroid"]


def test_only_used_columns_and_rows_are_read(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").withColumnsRenamed({"s_acctbal": "lat", "s_suppkey": "lon"})
    plan = geo_point_clustering(df.where("lat > 10"), ("lat", "lon"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*IsNotNull\(s_acctbal", plan) and "s_name" not in plan


def test_trees_of_aggregations(spark, places):
    df = places.withColumn("odd", F.col("id") % 2).withColumn("day", F.expr("timestamp '2024-01-30 12:00:00' + make_interval(0, 0, 0, cast(id as int))"))
    aggs = {
        "kinds": {"terms": {"field": "odd", "order": {"_key": "asc"}}, "aggs": {"mean": {"avg": {"field": "id"}}, "low": {"filter": {"range": {"id": {"lt": 5}}}, "aggs": {"n": {"value_count": {"field": "id"}}}}}},
        "steps": {"histogram": {"field": "id", "interval": 5}},
        "months": {"date_histogram": {"field": "day", "calendar_interval": "month"}},
        "days": {"date_histogram": {"field": "day", "fixed_interval": "2d"}},
        "parts": {"range": {"field": "id", "ranges": [{"to": 5}, {"from": 3, "to": 9, "key": "middle"}]}},
        "two": {"filters": {"filters": {"one": {"term": {"id": 1}}, "none": {"bool": {"must_not": {"exists": {"field": "id"}}}}}}},
        "gone": {"missing": {"field": "id"}},
        "first": {"top_hits": {"size": 2, "sort": [{"id": "desc"}], "_source": ["id"]}},
        "all": {"extended_stats": {"field": "id"}},
        "p": {"percentiles": {"field": "id", "percents": [50], "exact": True}},
    }
    response = to_response(from_request(df, {"geo_point_clustering": {"field": "point", "zoom": 9}, "aggs": aggs}))
    first, second = response["aggregations"]["clusters"]["buckets"]
    ids = {0: [1, 6, 7, 8, 9, 10, 11, 12, 15], 1: [2, 3, 4, 5, 13, 14]}
    for bucket, own in ((first, ids[0]), (second, ids[1])):
        for kind in bucket["kinds"]["buckets"]:
            mine = [i for i in own if i % 2 == int(kind["key"])]
            assert kind["doc_count"] == len(mine) and kind["mean"]["value"] == pytest.approx(sum(mine) / len(mine))
            low = [i for i in mine if i < 5]
            assert kind["low"] == {"doc_count": len(low), "n": {"value": len(low) or kind["low"]["n"]["value"]}}
        assert [(b["key"], b["doc_count"]) for b in bucket["steps"]["buckets"]] == sorted((5.0 * k, sum(i // 5 == k for i in own)) for k in {i // 5 for i in own})
        assert {b["key"]: b["doc_count"] for b in bucket["parts"]["buckets"]} == {k: n for k, n in (("*-5.0", sum(i < 5 for i in own)), ("middle", sum(3 <= i < 9 for i in own))) if n}
        assert {k: b["doc_count"] for k, b in bucket["two"]["buckets"].items()} == {"one": int(1 in own), "none": 0}
        assert bucket["gone"] == {"doc_count": 0}
        assert [h["id"] for h in bucket["first"]["hits"]] == sorted(own)[-2:][::-1]
        assert (bucket["all"]["count"], bucket["all"]["sum"], bucket["all"]["sum_of_squares"]) == (len(own), sum(own), sum(i * i for i in own))
        assert bucket["p"]["value"] == [np.median(own)]
        assert sum(b["doc_count"] for b in bucket["days"]["buckets"]) == len(own) == sum(b["doc_count"] for b in bucket["months"]["buckets"])
    for bad in ({"x": {"avg": {"field": "id"}, "aggs": {"y": {"avg": {"field": "id"}}}}}, {"x": {"terms": {"field": "id"}, "aggs": {"y": {"nothing": {}}}}}):
        with pytest.raises(ValueError):
            from_request(df, {"geo_point_clustering": {"field": "point"}, "aggs": bad})


def test_predicates(spark):
    df = spark.createDataFrame([(1, "a", (1.0, 1.0)), (2, "b", (5.0, 5.0)), (None, None, None)], "n int, s string, p struct<lat:double,lon:double>").withColumn("row", F.monotonically_increasing_id())
    chosen = lambda q: sorted(str(r.n) for r in df.where(predicate(q)).collect())
    assert chosen({"match_all": {}}) == ["1", "2", "None"]
    assert chosen({"term": {"s": "a"}}) == ["1"] and chosen({"terms": {"n": [1, 2]}}) == ["1", "2"]
    assert chosen({"range": {"n": {"gt": 1, "lte": 2}}}) == ["2"] and chosen({"exists": {"field": "s"}}) == ["1", "2"]
    assert chosen({"bool": {"must_not": [{"term": {"s": "a"}}]}}) == ["2", "None"]
    assert chosen({"bool": {"should": [{"term": {"s": "a"}}, {"term": {"n": 2}}]}}) == ["1", "2"]
    assert chosen({"geo_bounding_box": {"p": {"top_left": [0, 2], "bottom_right": {"lat": 0, "lon": 2}}}}) == ["1"]
    assert chosen({"geo_bounding_box": {"p": {"top": 2, "left": 0, "bottom": 0, "right": 2}}}) == ["1"]
    for bad in ({}, {"near": {"s": 1}}, {"bool": {"might": []}}):
        with pytest.raises(ValueError):
            predicate(bad)


def test_search_counts_its_hits(spark, places):
    more = places.select("id", "point").union(spark.createDataFrame([(99, None)], "id long, point struct<lat:double,lon:double>"))
    inner = {"geo_point_clustering": {"field": "point", "zoom": 9, "size": 1}, "aggs": {"mean": {"avg": {"field": "id"}}}, "meta": {"x": 1}}
    out = search(more, {"size": 0, "aggs": {"map": inner}})
    assert out["hits"]["total"]["value"] == 16 and [b["doc_count"] for b in out["aggregations"]["map"]["buckets"]] == [1] and out["aggregations"]["map"]["meta"] == {"x": 1}
    box = {"bool": {"must": {"match_all": {}}, "filter": {"geo_bounding_box": {"point": {"top_left": [2.23, 48.88], "bottom_right": [2.29, 48.84]}}}}}
    out = search(more, {"size": 0, "query": box, "aggs": {"map": {"geo_point_clustering": {"field": "point", "zoom": 9}}}})
    assert out["hits"]["total"]["value"] == 6 and [b["doc_count"] for b in out["aggregations"]["map"]["buckets"]] == [6]
    for bad in ({"size": 3}, {"from": 1}):
        with pytest.raises(ValueError):
            search(more, bad)


def test_buckets_are_counted_over_all_groups(places):
    df = places.withColumn("half", F.col("id") % 2)
    n = geo_point_clustering(df, "point", zoom=9, by=["half"]).count()
    assert geo_point_clustering(df, "point", zoom=9, by=["half"], max_buckets=n).count() == n
    with pytest.raises(ValueError, match="buckets"):
        geo_point_clustering(df, "point", zoom=9, by=["half"], max_buckets=n - 1)


def test_weights(places):
    df = places.withColumn("times", F.when(F.col("id") % 3 == 0, F.col("id")))
    twice = places.withColumn("times", F.explode(F.sequence(F.lit(1), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(1))))
    got, want = (ordered(geo_point_clustering(d, "point", zoom=9, aggs={"k": {"terms": {"field": "id", "size": 3}}}, **k)) for d, k in ((df, {"weight": "times"}), (twice, {})))
    assert [(r.doc_count, r.geohash_grids, r.k) for r in got] == [(r.doc_count, r.geohash_grids, r.k) for r in want]
    assert all(a.centroid == pytest.approx(b.centroid) for a, b in zip(got, want))


def test_rising_order_and_equal_results(places):
    down, up = (geo_point_clustering(places, "point", zoom=11, order=o) for o in ("falling", "rising"))
    assert [r.key for r in ordered(up)] == [r.key for r in ordered(down)][::-1]
    assert same_result(down, geo_point_clustering(places.repartition(5), "point", zoom=11))
    assert not same_result(down, up) and not same_result(down, geo_point_clustering(places, "point", zoom=10)) and not same_result(down, down.drop("doc_count"))
    moved = down.withColumn("centroid", F.struct(F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon")))
    assert same_result(down, moved)
    with pytest.raises(ValueError):
        geo_point_clustering(places, "point", order="sideways")


def test_sample_by_key_scales_every_level(spark):
    df = spark.range(8000).select("id", F.struct(F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon")).alias("point"), (F.col("id") % 2).cast("string").alias("kind"))
    aggs = {"kinds": {"terms": {"field": "kind"}, "aggs": {"n": {"value_count": {"field": "id"}}, "s": {"stats": {"field": "id"}}}}}
    one, two = (ordered(geo_point_clustering(d, "point", sample=0.25, sample_key="id", seed=3, aggs=aggs)) for d in (df, df.repartition(7)))
    assert one == two
    (r,) = one
    read = df.where(sampled(F.col("id"), 0.25, 3))
    assert r.doc_count == 4 * read.count() and abs(r.doc_count - 8000) < 800
    for k in r.kinds:
        mine = read.where(F.col("kind") == k["key"])
        assert k["doc_count"] == k["n"] == k["s"]["count"] == 4 * mine.count() and k["s"]["sum"] == 4 * mine.agg(F.sum("id")).first()[0]


def test_parameters_copied():
    p = ClusterParams(zoom=3)
    assert replace(p, radius=50) == ClusterParams(zoom=3, radius=50) and replace(p) == p


def test_merge_is_planned_once(places):
    plan = geo_point_clustering(places, "point", zoom=9, aggs={"d": {"cardinality": {"field": "id"}}})._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan
