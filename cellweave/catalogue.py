"""Registered queries over points derived from the events table, and independent SQL for each."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geohash as g
from .operators import cells as c
from .operators.clustering import from_request, geo_point_clustering
from .plans.params import ClusterParams
from .sources.points import bounding_box, point
from .sources.response import with_json

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LAT = "cast((user_id * 40503) % 1400 as double) / 1e1 - 7e1 + cast((event_id * 17) % 41 - 20 as double) / 1e3"
LON = "cast((user_id * 2654435) % 3400 as double) / 1e1 - 17e1 + cast((event_id * 31) % 41 - 20 as double) / 1e3"
#: For DuckDB: the points, and what its numbers mean.
PTS = f"pts AS (SELECT event_id, user_id, event_type, value, {LAT} AS lat, {LON} AS lon FROM events)"
LAT_STEP, LON_STEP = "(180e0 / 4294967296e0)", "(360e0 / 4294967296e0)"
_RADIUS = 6371008.7714


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of events: lat and lon beside the columns that queries use."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", F.expr(LAT).alias("lat"), F.expr(LON).alias("lon"))


def _steps(x: str, step: str) -> str:
    return f"CAST(floor({x} / {step}) AS BIGINT)"


def sql_cell(lat: str, lon: str, level: int) -> str:
    """Key of the cell from its bits, one at a time."""
    n = 5 * level
    nlon, nlat = (n + 1) // 2, n // 2
    x, y = f"(({lon}) + 2147483648) // {1 << (32 - nlon)}", f"(({lat}) + 2147483648) // {1 << (32 - nlat)}"
    bits = [f"((({x}) // {1 << i}) % 2) * {1 << (n - 1 - 2 * (nlon - 1 - i))}" for i in range(nlon)]
    bits += [f"((({y}) // {1 << i}) % 2) * {1 << (n - 2 - 2 * (nlat - 1 - i))}" for i in range(nlat)]
    return f"(({' + '.join(bits)}) * 16 + {level})"


def sql_geohash(key: str, level: int) -> str:
    return " || ".join(f"substr('{g.ALPHABET}', CAST((({key} // 16) // {1 << 5 * (level - 1 - i)}) % 32 AS INTEGER) + 1, 1)" for i in range(level))


def sql_distance(a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> str:
    s1, s2 = f"sin(radians({b_lat} - {a_lat}) / 2)", f"sin(radians({b_lon} - {a_lon}) / 2)"
    return f"(2 * {_RADIUS}e0 * asin(least(1e0, sqrt({s1} * {s1} + cos(radians({a_lat})) * cos(radians({b_lat})) * {s2} * {s2}))))"


def sql_cells(level: int, by: Sequence[str] = (), where: str = "true") -> str:
    """Common tables pts and cells (by, cell, n, lat, lon)."""
    keys = ", ".join([*by, "cell"])
    y, x = _steps("lat", LAT_STEP), _steps("lon", LON_STEP)
    return f"""{PTS},
stored AS (SELECT *, {y} AS y, {x} AS x FROM pts WHERE {where}),
celled AS (SELECT *, {sql_cell("y", "x", level)} AS cell FROM stored),
cells AS (SELECT {keys}, count(*) AS n, sum(y) / count(*)::DOUBLE * {LAT_STEP} AS lat, sum(x) / count(*)::DOUBLE * {LON_STEP} AS lon FROM celled GROUP BY {keys})"""


def sql_clusters(params: ClusterParams, by: Sequence[str] = (), where: str = "true") -> str:
    """Common tables up to clusters (by, cluster_rank, cell, n, lat, lon, members): the head of the list founds a cluster, a fold over the rest lets it grow, a second fold looks again at those just outside."""
    r, ratio = repr(float(params.radius_metres)), repr(float(params.ratio))
    lead = "".join(f"{b}, " for b in by)
    d = sql_distance("a.lat", "a.lon", "c.lat", "c.lon")
    reach = f"({r} * cos(radians((a.lat + c.lat) / 2)))"
    grown = "struct_pack(n := a.n + c.n, lat := (a.lat * a.n + c.lat * c.n) / (a.n + c.n), lon := (a.lon * a.n + c.lon * c.n) / (a.n + c.n), members := list_append(a.members, c.cell), kept := a.kept)"
    left = "struct_pack(n := a.n, lat := a.lat, lon := a.lon, members := a.members, kept := list_append(a.kept, {c}))"
    mark = f"struct_pack(cell := c.cell, n := c.n, lat := c.lat, lon := c.lon, edge := {ratio} > 0 AND {d} / {reach} < {ratio})"
    none = "[]::STRUCT(cell BIGINT, n BIGINT, lat DOUBLE, lon DOUBLE, edge BOOLEAN)[]"
    first = f"list_reduce(rest[2:], lambda a, c: CASE WHEN {d} <= {reach} THEN {grown} ELSE {left.format(c=mark)} END, struct_pack(n := rest[1].n, lat := rest[1].lat, lon := rest[1].lon, members := [rest[1].cell], kept := {none}))"
    second = f"list_reduce(s.kept, lambda a, c: CASE WHEN c.edge AND {d} <= {reach} THEN {grown} ELSE {left.format(c='c')} END, struct_pack(n := s.n, lat := s.lat, lon := s.lon, members := s.members, kept := {none}))"
    top = f"row_number() OVER ({'PARTITION BY ' + ', '.join(by) if by else ''} ORDER BY cell DESC) <= {params.size}"
    return f"""{sql_cells(params.level, by, where)},
topped AS (SELECT * FROM cells QUALIFY {top}),
walk AS (
  SELECT {lead}0 AS step, list(struct_pack(cell := cell::BIGINT, n := n::BIGINT, lat := lat, lon := lon, edge := false) ORDER BY cell DESC) AS rest, NULL::BIGINT AS seed,
         NULL::STRUCT(n BIGINT, lat DOUBLE, lon DOUBLE, members BIGINT[], kept STRUCT(cell BIGINT, n BIGINT, lat DOUBLE, lon DOUBLE, edge BOOLEAN)[]) AS done
  FROM topped {"GROUP BY " + ", ".join(by) if by else "HAVING count(*) > 0"}
  UNION ALL
  SELECT {lead}step + 1, f.kept, seed, f FROM (
    SELECT {lead}step, seed, {second} AS f FROM (SELECT {lead}step, rest[1].cell AS seed, {first} AS s FROM walk WHERE len(rest) > 0)
  )
),
clusters AS (SELECT {lead}step - 1 AS cluster_rank, seed AS cell, done.n AS n, done.lat AS lat, done.lon AS lon, done.members AS members FROM walk WHERE step > 0)"""


def clustering_sql(params: ClusterParams, by: Sequence[str] = (), where: str = "true") -> str:
    lead = "".join(f"{b}, " for b in by)
    grids = f"array_to_string(list_transform(list_sort(members, 'DESC'), lambda m: {sql_geohash('m', params.level)}), ',')"
    return f"WITH RECURSIVE {sql_clusters(params, by, where)} SELECT {lead}CAST(cluster_rank AS INTEGER) AS cluster_rank, {sql_geohash('cell', params.level)} AS key, {grids} AS geohash_grids, CAST(n AS BIGINT) AS doc_count, round(lat, 6) AS lat, round(lon, 6) AS lon FROM clusters"


def flat(clusters: DataFrame, *more: str) -> DataFrame:
    """Clusters with plain columns, rounded, for comparison."""
    lead = clusters.columns[: clusters.columns.index("cluster_rank")]
    return clusters.select(*lead, "cluster_rank", "key", F.array_join("geohash_grids", ",").alias("geohash_grids"), "doc_count", F.round("centroid.lat", 6).alias("lat"), F.round("centroid.lon", 6).alias("lon"), *more)


def query(sql: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


_y, _x = _steps("lat", LAT_STEP), _steps("lon", LON_STEP)


@query(f"WITH {PTS} SELECT event_id, {_y} AS lat_steps, {_x} AS lon_steps, round({_y} * {LAT_STEP}, 6) AS lat, round({_x} * {LON_STEP}, 6) AS lon FROM pts")
def quantise_points(spark, sf_dir):
    y, x = g.quantise_lat(F.col("lat")), g.quantise_lon(F.col("lon"))
    return points(spark, sf_dir).select("event_id", y.alias("lat_steps"), x.alias("lon_steps"), F.round(g.degrees_lat(y), 6).alias("lat"), F.round(g.degrees_lon(x), 6).alias("lon"))


@query(f"WITH {PTS} SELECT event_id, {sql_cell(_y, _x, 5)} AS cell5, {sql_cell(_y, _x, 8)} AS cell8 FROM pts")
def geohash_cell_key(spark, sf_dir):
    df = points(spark, sf_dir).withColumns({"y": g.quantise_lat(F.col("lat")), "x": g.quantise_lon(F.col("lon"))})
    return g.with_cell(g.with_cell(df, "y", "x", 5, "cell5"), "y", "x", 8, "cell8").select("event_id", "cell5", "cell8")


@query(f"WITH {PTS} SELECT event_id, {sql_geohash(sql_cell(_y, _x, 7), 7)} AS geohash FROM pts")
def geohash_string(spark, sf_dir):
    df = points(spark, sf_dir).withColumns({"y": g.quantise_lat(F.col("lat")), "x": g.quantise_lon(F.col("lon"))})
    return g.with_cell(df, "y", "x", 7, "cell").select("event_id", g.geohash(F.col("cell"), 7).alias("geohash"))


@query(f"WITH {PTS} SELECT event_id, round((({_y} + 2147483648) // {1 << 17} * {1 << 17} - 2147483648) * {LAT_STEP}, 6) AS lat, round((({_x} + 2147483648) // {1 << 17} * {1 << 17} - 2147483648) * {LON_STEP}, 6) AS lon FROM pts")
def geohash_decode(spark, sf_dir):
    df = points(spark, sf_dir).withColumns({"y": g.quantise_lat(F.col("lat")), "x": g.quantise_lon(F.col("lon"))})
    lat, lon = g.corner(F.col("cell"), 6)
    return g.with_cell(df, "y", "x", 6, "cell").select("event_id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query(f"WITH {PTS} SELECT event_id, {_y} * 4294967296 + (({_x} + 4294967296) % 4294967296) AS packed, {_y} AS lat_steps, {_x} AS lon_steps FROM pts")
def pack_unpack(spark, sf_dir):
    df = points(spark, sf_dir).withColumn("packed", g.pack(g.quantise_lat(F.col("lat")), g.quantise_lon(F.col("lon"))))
    return df.select("event_id", "packed", g.unpack_lat(F.col("packed")).alias("lat_steps"), g.unpack_lon(F.col("packed")).alias("lon_steps"))


@query(f"WITH {PTS} SELECT event_id, round({sql_distance('lat', 'lon', '48.85e0', '2.35e0')}, 3) AS metres FROM pts")
def arc_distance(spark, sf_dir):
    return points(spark, sf_dir).select("event_id", F.round(g.arc_distance(F.col("lat"), F.col("lon"), F.lit(48.85), F.lit(2.35)), 3).alias("metres"))


@query(f"WITH {PTS} SELECT event_id, round({ClusterParams(zoom=9).radius_metres!r} * cos(radians((lat + 48.85e0) / 2)), 3) AS metres FROM pts")
def corrected_radius(spark, sf_dir):
    return points(spark, sf_dir).select("event_id", F.round(g.radius_at(ClusterParams(zoom=9).radius_metres, F.col("lat"), F.lit(48.85)), 3).alias("metres"))


def _cells(df: DataFrame, level: int) -> DataFrame:
    out = c.aggregate(c.located_columns(df, "lat", "lon", level))
    return out.select(F.col("__cell").alias("cell"), F.col("__n").alias("doc_count"), F.round("__lat", 6).alias("lat"), F.round("__lon", 6).alias("lon"))


_CELLS = "SELECT cell, n AS doc_count, round(lat, 6) AS lat, round(lon, 6) AS lon FROM cells"


@query(f"WITH {sql_cells(3)} {_CELLS}")
def cell_aggregate(spark, sf_dir):
    return _cells(points(spark, sf_dir), 3)


@query(f"WITH {sql_cells(4)} {_CELLS} ORDER BY cell DESC LIMIT 50")
def cell_topk(spark, sf_dir):
    return _cells(points(spark, sf_dir), 4).orderBy(F.desc("cell")).limit(50)


@query(
    f"""WITH {PTS}, many AS (SELECT event_id % 500 AS doc, {_y} AS y, {_x} AS x FROM pts),
    celled AS (SELECT *, {sql_cell("y", "x", 1)} AS cell, lag({sql_cell("y", "x", 1)}) OVER (PARTITION BY doc ORDER BY y, (x + 4294967296) % 4294967296) AS before FROM many)
    SELECT cell, count(*) AS doc_count, sum(y)::BIGINT AS lat_sum, sum(x)::BIGINT AS lon_sum FROM celled WHERE before IS NULL OR before <> cell GROUP BY cell"""
)
def multi_value_dedupe(spark, sf_dir):
    docs = points(spark, sf_dir).groupBy((F.col("event_id") % 500).alias("doc")).agg(F.collect_list(point(F.col("lat"), F.col("lon"))).alias("points"))
    located = c.located(docs, "points", 1)
    return located.groupBy(F.col("__cell").alias("cell")).agg(F.count(F.lit(1)).alias("doc_count"), F.sum("__lat").alias("lat_sum"), F.sum("__lon").alias("lon_sum"))


@query(f"WITH {sql_cells(2, where='event_id % 7 <> 0 AND event_id % 11 <> 0')} {_CELLS}")
def null_skip(spark, sf_dir):
    df = points(spark, sf_dir).withColumns({"lat": F.when(F.col("event_id") % 7 != 0, F.col("lat")), "lon": F.when(F.col("event_id") % 11 != 0, F.col("lon"))})
    return _cells(df, 2)


@query(
    f"""WITH {PTS}, filled AS (SELECT CASE WHEN event_id % 7 <> 0 THEN lat ELSE 48.85e0 END AS lat, CASE WHEN event_id % 7 <> 0 THEN lon ELSE 2.35e0 END AS lon FROM pts),
    celled AS (SELECT {_y} AS y, {_x} AS x, {sql_cell(_y, _x, 2)} AS cell FROM filled)
    SELECT cell, count(*) AS doc_count, round(sum(y) / count(*)::DOUBLE * {LAT_STEP}, 6) AS lat, round(sum(x) / count(*)::DOUBLE * {LON_STEP}, 6) AS lon FROM celled GROUP BY cell"""
)
def missing_value(spark, sf_dir):
    df = points(spark, sf_dir).withColumn("point", F.when(F.col("event_id") % 7 != 0, point(F.col("lat"), F.col("lon"))))
    out = c.aggregate(c.located(df, "point", 2, missing=[2.35, 48.85]))
    return out.select(F.col("__cell").alias("cell"), F.col("__n").alias("doc_count"), F.round("__lat", 6).alias("lat"), F.round("__lon", 6).alias("lon"))


@query("SELECT 0::INTEGER AS cluster_rank, '' AS key, '' AS geohash_grids, 0::BIGINT AS doc_count, 0::DOUBLE AS lat, 0::DOUBLE AS lon WHERE false")
def unmapped_empty(spark, sf_dir):
    return flat(geo_point_clustering(points(spark, sf_dir), "no_such_field"))


BOX = dict(top=48.88, left=-20.0, bottom=-30.0, right=40.0)
_BOX_SQL = f"{_y} BETWEEN {_steps('-30e0', LAT_STEP)} AND {_steps('48.88e0', LAT_STEP)} AND {_x} BETWEEN {_steps('-20e0', LON_STEP)} AND {_steps('40e0', LON_STEP)}"


@query(f"WITH {PTS} SELECT event_id FROM pts WHERE {_BOX_SQL}")
def bbox_filter(spark, sf_dir):
    return points(spark, sf_dir).where(bounding_box(F.col("lat"), F.col("lon"), **BOX)).select("event_id")


@query(f"WITH {PTS} SELECT event_id FROM pts WHERE {_y} BETWEEN {_steps('-30e0', LAT_STEP)} AND {_steps('30e0', LAT_STEP)} AND ({_x} >= {_steps('160e0', LON_STEP)} OR {_x} <= {_steps('-150e0', LON_STEP)})")
def bbox_dateline(spark, sf_dir):
    return points(spark, sf_dir).where(bounding_box(F.col("lat"), F.col("lon"), top=30.0, left=160.0, bottom=-30.0, right=-150.0)).select("event_id")


@query(clustering_sql(ClusterParams(zoom=2), where=_BOX_SQL))
def bbox_cluster(spark, sf_dir):
    return flat(geo_point_clustering(points(spark, sf_dir).where(bounding_box(F.col("lat"), F.col("lon"), **BOX)), ("lat", "lon"), zoom=2))


def _clustering(name: str, by: Sequence[str] = (), **settings) -> None:
    def run(spark, sf_dir):
        return flat(geo_point_clustering(points(spark, sf_dir), ("lat", "lon"), by=by, **settings))

    QUERIES[name] = run
    ORACLES[name] = clustering_sql(ClusterParams(**settings), by)


for _zoom in (0, 1, 2, 3, 5):
    _clustering(f"cluster_zoom{_zoom}", zoom=_zoom)
_clustering("cluster_radius_extent", zoom=1, radius=60, extent=512)
_clustering("cluster_radius", zoom=1, radius=80)
_clustering("cluster_ratio", zoom=1, ratio=1.2)
_clustering("cluster_ratio_no_effect", zoom=1, ratio=1.0)
_clustering("cluster_size_limit", zoom=1, size=50)
_clustering("cluster_by_event_type", by=["event_type"], zoom=1)
_clustering("cluster_by_size_limit", by=["event_type"], zoom=1, size=40, ratio=1.5)


@query(
    f"""WITH RECURSIVE {sql_clusters(ClusterParams(zoom=1))}, member AS (SELECT cluster_rank, unnest(members) AS m FROM clusters)
    SELECT CAST(cluster_rank AS INTEGER) AS cluster_rank, count(*) AS doc_count, round(avg(value), 6) AS mean, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, count(value) AS n
    FROM celled JOIN member ON cell = m GROUP BY cluster_rank"""
)
def cluster_subaggs(spark, sf_dir):
    metrics = {"mean": ("avg", "value"), "total": ("sum", "value"), "least": ("min", "value"), "most": ("max", "value"), "n": ("count", "value")}
    out = geo_point_clustering(points(spark, sf_dir), ("lat", "lon"), zoom=1, metrics=metrics)
    return out.select("cluster_rank", "doc_count", F.round("mean", 6).alias("mean"), F.round("total", 4).alias("total"), "least", "most", "n")


@query(
    f"""WITH RECURSIVE {sql_clusters(ClusterParams(zoom=1))}, member AS (SELECT cluster_rank, unnest(members) AS m FROM clusters)
    SELECT CAST(cluster_rank AS INTEGER) AS cluster_rank, count(DISTINCT user_id) AS users, round(quantile_cont(value, 0.5), 6) AS middle FROM celled JOIN member ON cell = m GROUP BY cluster_rank"""
)
def cluster_subaggs_any(spark, sf_dir):
    out = geo_point_clustering(points(spark, sf_dir), ("lat", "lon"), zoom=1, aggs={"users": F.count_distinct("user_id"), "middle": F.percentile("value", F.lit(0.5))})
    return out.select("cluster_rank", "users", F.round("middle", 6).alias("middle"))


@query(
    f"""WITH RECURSIVE {sql_clusters(ClusterParams(zoom=1))}, member AS (SELECT cluster_rank, unnest(members) AS m FROM clusters),
    counted AS (SELECT cluster_rank, event_type, count(*) AS times FROM celled JOIN member ON cell = m GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY cluster_rank ORDER BY times DESC, event_type) AS place FROM counted)
    SELECT CAST(cluster_rank AS INTEGER) AS cluster_rank, string_agg(event_type || '=' || times, ',' ORDER BY place) AS kinds FROM placed WHERE place <= 3 GROUP BY cluster_rank"""
)
def cluster_terms(spark, sf_dir):
    request = {"geo_point_clustering": {"field": "point", "zoom": 1}, "aggs": {"kinds": {"terms": {"field": "event_type", "size": 3}}}}
    df = points(spark, sf_dir).withColumn("point", point(F.col("lat"), F.col("lon")))
    kinds = F.transform("kinds", lambda t: F.concat_ws("=", t["key"], t["doc_count"].cast("string")))
    return from_request(df, request).select("cluster_rank", F.array_join(kinds, ",").alias("kinds"))


@query(
    f"""WITH RECURSIVE {sql_clusters(ClusterParams(zoom=1))}, member AS (SELECT cluster_rank, unnest(members) AS m FROM clusters),
    own AS (SELECT cluster_rank, event_type, user_id, value, 25 * floor(value / 25) AS low FROM celled JOIN member ON cell = m),
    kind AS (SELECT cluster_rank, event_type, count(*) AS times, count(DISTINCT user_id) AS users FROM own GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY cluster_rank ORDER BY times DESC, event_type) AS place FROM kind),
    step AS (SELECT cluster_rank, event_type, low, count(*) AS n, round(sum(value), 2) AS total FROM own WHERE value IS NOT NULL GROUP BY ALL),
    inner_ AS (SELECT cluster_rank, event_type, string_agg(CAST(low AS INTEGER) || ':' || n || ':' || total, ';' ORDER BY low) AS steps FROM step GROUP BY ALL),
    kinds AS (SELECT cluster_rank, string_agg(event_type || '=' || times || '/' || users || '[' || coalesce(steps, '') || ']', ',' ORDER BY place) AS kinds FROM placed LEFT JOIN inner_ USING (cluster_rank, event_type) WHERE place <= 2 GROUP BY cluster_rank),
    upper_ AS (SELECT cluster_rank, count(*) FILTER (value >= 50) AS high, round(max(value) FILTER (value >= 50), 4) AS most FROM own GROUP BY cluster_rank)
    SELECT CAST(cluster_rank AS INTEGER) AS cluster_rank, kinds, high, most FROM kinds JOIN upper_ USING (cluster_rank)"""
)
def cluster_nested(spark, sf_dir):
    steps = {"steps": {"histogram": {"field": "value", "interval": 25}, "aggs": {"total": {"sum": {"field": "value"}}}}, "users": {"cardinality": {"field": "user_id", "exact": True}}}
    aggs = {"kinds": {"terms": {"field": "event_type", "size": 2}, "aggs": steps}, "high": {"filter": {"range": {"value": {"gte": 50}}}, "aggs": {"most": {"max": {"field": "value"}}}}}
    df = points(spark, sf_dir).withColumn("point", point(F.col("lat"), F.col("lon")))
    out = from_request(df, {"geo_point_clustering": {"field": "point", "zoom": 1}, "aggs": aggs})
    step = lambda h: F.concat_ws(":", h["key"].cast("int").cast("string"), h["doc_count"].cast("string"), F.round(h["total"], 2).cast("string"))
    kind = lambda t: F.concat(t["key"], F.lit("="), t["doc_count"], F.lit("/"), t["users"], F.lit("["), F.array_join(F.coalesce(F.transform(t["steps"], step), F.array()), ";"), F.lit("]"))
    return out.select("cluster_rank", F.array_join(F.transform("kinds", kind), ",").alias("kinds"), F.col("high.doc_count").alias("high"), F.round("high.most", 4).alias("most"))


@query(
    f"""WITH RECURSIVE {sql_clusters(ClusterParams(zoom=2))}
    SELECT CAST(cluster_rank AS INTEGER) AS cluster_rank, '{{"geohash_grids":["' || array_to_string(list_transform(list_sort(members, 'DESC'), lambda m: {sql_geohash('m', ClusterParams(zoom=2).level)}), '","') || '"],"doc_count":' || n || ',"centroid":{{"lat":' || round(lat, 3) || ',"lon":' || round(lon, 3) || '}}}}' AS json FROM clusters"""
)
def cluster_json(spark, sf_dir):
    out = geo_point_clustering(points(spark, sf_dir), ("lat", "lon"), zoom=2)
    near = F.struct(F.round("centroid.lat", 3).alias("lat"), F.round("centroid.lon", 3).alias("lon"))
    return with_json(out.withColumn("centroid", near)).select("cluster_rank", "json")


@query(
    f"""WITH RECURSIVE {sql_clusters(ClusterParams(zoom=1), where=f"substr(md5('11:' || event_id), 1, 8) < '{int(0.1 * (1 << 32)):08x}'")},
    member AS (SELECT cluster_rank, unnest(members) AS m FROM clusters),
    kind AS (SELECT cluster_rank, event_type, count(*) AS times, sum(value) AS total FROM celled JOIN member ON cell = m GROUP BY ALL)
    SELECT CAST(cluster_rank AS INTEGER) AS cluster_rank, CAST(sum(times) * 10 AS BIGINT) AS doc_count, round(sum(total) * 10, 3) AS total,
           string_agg(event_type || '=' || times * 10 || ':' || round(total * 10, 2), ',' ORDER BY event_type) AS kinds FROM kind GROUP BY cluster_rank"""
)
def cluster_sampled(spark, sf_dir):
    """A tenth of the rows, told by a hash of their key; counts and sums are scaled up at both levels."""
    kinds = {"kinds": {"terms": {"field": "event_type", "order": {"_key": "asc"}}, "aggs": {"total": {"sum": {"field": "value"}}}}}
    out = geo_point_clustering(points(spark, sf_dir), ("lat", "lon"), zoom=1, metrics={"total": ("sum", "value")}, aggs=kinds, sample=0.1, sample_key="event_id", seed=11)
    kind = lambda t: F.concat(t["key"], F.lit("="), t["doc_count"], F.lit(":"), F.round(t["total"], 2))
    return out.select("cluster_rank", "doc_count", F.round("total", 3).alias("total"), F.array_join(F.transform("kinds", kind), ",").alias("kinds"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters at zoom 1 with a wide radius, as the response has them."""
    return geo_point_clustering(points(spark, sf_dir), ("lat", "lon"), zoom=1, radius=120, metrics={"mean_value": ("avg", "value")})


assert math.isclose(g.EARTH_RADIUS_METRES, _RADIUS)
