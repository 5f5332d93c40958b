"""Clusters of points for a map."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geohash as g
from ..plans.params import ClusterParams, Request
from ..plans.storage import once
from ..sources.points import POINT
from . import cells as c
from .merge import merge_cells
from .subaggs import Counting, parse, tree


def _parts(metrics: Mapping[str, tuple[str, str]]) -> list[tuple[str, str]]:
    """Columns that hold the parts of metrics, and how they add up."""
    of = {"sum": ["sum"], "avg": ["sum", "count"], "count": ["count"], "min": ["min"], "max": ["max"]}
    return [(f"{name}__{part}", "sum" if part == "count" else part) for name, (kind, _) in metrics.items() for part in of[kind]]


def _add_up(values: np.ndarray, cluster: np.ndarray, n: int, how: str) -> np.ndarray:
    """Of each cluster; cells without a value (nan) don't count, a cluster of such has none."""
    known = ~np.isnan(values)
    start = {"sum": 0.0, "min": np.inf, "max": -np.inf}[how]
    out = np.full(n, start)
    {"sum": np.add, "min": np.minimum, "max": np.maximum}[how].at(out, cluster[known], values[known])
    seen = np.zeros(n, bool)
    seen[cluster[known]] = True
    return np.where(seen, out, np.nan)


def merge(cells: DataFrame, params: ClusterParams, by: Sequence[str] = (), metrics: Mapping[str, tuple[str, str]] | None = None, *, rising: bool = False) -> DataFrame:
    """Clusters of (a bounded number of) cells: by, cluster_rank, __cells in falling order, doc_count, __lat, __lon, parts of metrics.

    Ranks follow falling keys, in which clusters are found, or rising ones.
    """
    parts = _parts(metrics or {})
    radius, ratio = params.radius_metres, params.ratio
    head = [cells.schema[b] for b in by]
    tail = [T.StructField(n, T.DoubleType()) for n, _ in parts]
    schema = T.StructType([*head, T.StructField("cluster_rank", T.IntegerType()), T.StructField("__key", T.LongType()), T.StructField("__cells", T.ArrayType(T.LongType())), T.StructField("doc_count", T.LongType()), T.StructField("__y", T.DoubleType()), T.StructField("__x", T.DoubleType()), *tail])

    def run(table: pa.Table) -> pa.Table:
        key = table.column("__cell").to_numpy()
        order = np.argsort(key)[::-1]
        take = lambda name: table.column(name).to_numpy()[order]
        key = key[order]
        cluster, n, lat, lon = merge_cells(take("__n"), take("__lat"), take("__lon"), radius, ratio)
        first = np.argsort(cluster, kind="stable")
        at = np.concatenate([[0], np.cumsum(np.bincount(cluster, minlength=len(n)))])
        columns = [pa.array([table.column(b)[0].as_py()] * len(n), table.schema.field(b).type) for b in by]
        rank = np.arange(len(n), dtype=np.int32)
        columns += [pa.array(rank[::-1] if rising else rank), pa.array(key[first[at[:-1]]]), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(key[first])), pa.array(n), pa.array(lat), pa.array(lon)]
        for name, how in parts:
            values = np.asarray(take(name), float)
            columns.append(pa.array(_add_up(values, cluster, len(n), how), from_pandas=True))
        return pa.table(columns, names=schema.names)

    return cells.groupBy(*by).applyInArrow(run, schema)


def _finished(clusters: DataFrame, level: int, by: Sequence[str], metrics: Mapping[str, tuple[str, str]]) -> DataFrame:
    lat, lon = g.corner(F.col("__key"), level)
    made: list[Column] = []
    for name, (kind, _) in metrics.items():
        if kind == "avg":
            made.append(F.when(F.col(f"{name}__count") > 0, F.col(f"{name}__sum") / F.col(f"{name}__count")).alias(name))
        elif kind == "count":
            made.append(F.coalesce(F.col(f"{name}__count"), F.lit(0.0)).cast("bigint").alias(name))
        else:
            made.append(F.col(f"{name}__{kind}").alias(name))
    return clusters.select(
        *by,
        "cluster_rank",
        g.geohash(F.col("__key"), level).alias("key"),
        F.struct(lat.alias("lat"), lon.alias("lon")).alias("key_point"),
        F.transform(F.sort_array("__cells", asc=False), lambda x: g.geohash(x, level)).alias("geohash_grids"),
        "doc_count",
        F.struct(F.col("__y").alias("lat"), F.col("__x").alias("lon")).alias("centroid"),
        *made,
    )


def output_schema(df: DataFrame, by: Sequence[str] = (), metrics: Mapping[str, tuple[str, str]] | None = None) -> T.StructType:
    kinds = [T.StructField(n, T.LongType() if k == "count" else T.DoubleType()) for n, (k, _) in (metrics or {}).items()]
    return T.StructType([*(df.schema[b] for b in by), T.StructField("cluster_rank", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("key_point", POINT), T.StructField("geohash_grids", T.ArrayType(T.StringType())), T.StructField("doc_count", T.LongType()), T.StructField("centroid", POINT), *kinds])


def geo_point_clustering(
    df: DataFrame,
    point: str | tuple[str, str],
    *,
    zoom: int = 1,
    radius: int = 40,
    ratio: float = 0.0,
    extent: int = 256,
    size: int = 10_000,
    shard_size: int | None = None,
    by: Sequence[str] = (),
    metrics: Mapping[str, tuple[str, str]] | None = None,
    aggs: Mapping[str, Column | Mapping[str, Any]] | None = None,
    terms: Mapping[str, tuple[str, int]] | None = None,
    missing: Any = None,
    weight: str | None = None,
    sample: float | None = None,
    sample_key: str | None = None,
    seed: int = 0,
    max_buckets: int | None = None,
    order: str = "falling",
) -> DataFrame:
    """Clusters of the points in df, one row each.

    point: a column of points (or arrays of them, or text), or the names of a latitude and a longitude column.
    by: groups that are clustered apart.  metrics: {name: (sum | min | max | count | avg, column)}, put together from the
    cells' own.  aggs: {name: any aggregate column, or a tree of aggregations in request form}, computed over the cluster's rows.
    terms: {name: (column, n)}, the cluster's n commonest values with their counts.  missing: a point for rows without one.
    weight: a column of whole numbers, how many documents a row stands for.
    sample: share of the rows to read; counts and sums are scaled up, at every level but in aggregate columns.  With
    sample_key, a row is read or not by a hash of that column and seed, the same ones every time.
    max_buckets: more clusters, all groups taken together, are an error.  order: ranks by falling or rising cell keys.

    With aggs, terms or max_buckets the merged clusters, at most `size` a group, are computed at once and kept.
    A field that df lacks gives no clusters; so does a table without points.
    """
    params = ClusterParams(zoom, radius, extent, ratio, size, shard_size)
    metrics, by, level = dict(metrics or {}), list(by), params.level
    aggs = dict(aggs or {}) | {name: {"terms": {"field": column, "size": n}} for name, (column, n) in (terms or {}).items()}
    if order not in ("falling", "rising"):
        raise ValueError("order must be falling or rising")
    for name, spec in aggs.items():
        if not isinstance(spec, Column):
            parse(name, spec)
    if sample is not None:
        if not 0 < sample <= 1:
            raise ValueError("sample must be above 0 and at most 1")
        df = df.sample(sample, seed) if sample_key is None else df.where(sampled(F.col(sample_key), sample, seed))
    counting = Counting(weight, sample or 1.0)
    if isinstance(point, str):
        located = c.located(df, point, level, missing)
    elif missing is None:
        located = c.located_columns(df, *point, level)
    else:
        located = c.located(df.withColumn("__point", F.struct(F.col(point[0]).alias("lat"), F.col(point[1]).alias("lon"))), "__point", level, missing)
    if located is None:
        schema = output_schema(df, by, metrics)
        empty = df.sparkSession.createDataFrame([], schema)
        names = [f"__by{i}" for i in range(len(by))]
        none = tree(df.where(F.lit(False)).withColumns({n: F.col(b) for n, b in zip(names, by)}), names, aggs, counting) if aggs else None
        return empty.select("*", *[F.lit(None).cast(none.schema[n].dataType).alias(n) for n in aggs])
    merged = merge(c.greatest(c.aggregate(located, by, metrics, weight), params.size, by), params, by, metrics, rising=order == "rising")
    if aggs or max_buckets is not None:
        merged = once(merged)
    if max_buckets is not None and (n := merged.count()) > max_buckets:
        raise ValueError(f"more than {max_buckets} buckets: {n}")
    out = _finished(merged, level, by, metrics)
    if aggs:
        out = _with_aggs(out, merged, located, by, aggs, counting)
    if sample is not None:
        scaled = {n for n, (k, _) in metrics.items() if k in ("sum", "count")}
        out = out.withColumns({"doc_count": F.round(F.col("doc_count") / sample).cast("bigint")} | {n: (F.round(F.col(n) / sample) if metrics[n][0] == "count" else F.col(n) / sample).cast(out.schema[n].dataType) for n in scaled})
    return out


def sampled(key: Column, share: float, seed: int = 0) -> Column:
    """Whether a key is among a share of all: the first 32 bits of the MD5 of "seed:key" decide."""
    limit = F.lit(f"{int(share * (1 << 32)):09x}")
    return F.concat(F.lit("0"), F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 8)) < limit


def _with_aggs(out: DataFrame, merged: DataFrame, located: DataFrame, by: Sequence[str], aggs: Mapping[str, Any], counting: Counting) -> DataFrame:
    """Rows find their cluster by cell (at most `size` cells a group), and are aggregated again."""
    names = [f"__by{i}" for i in range(len(by))]
    members = merged.select(*[F.col(b).alias(n) for b, n in zip(by, names)], F.col("cluster_rank").alias("__rank"), F.explode("__cells").alias("__member"))
    match = F.col("__cell") == F.col("__member")
    for b, n in zip(by, names):
        match &= F.col(b).eqNullSafe(F.col(n))
    extra = tree(located.join(members, match), [*names, "__rank"], aggs, counting)
    match = F.col("cluster_rank") == F.col("__rank")
    for b, n in zip(by, names):
        match &= F.col(b).eqNullSafe(F.col(n))
    return out.join(extra, match, "left").drop("__rank", *names)


#: Sub-aggregations of requests that are put together from cells.
_SIMPLE = {"avg": "avg", "sum": "sum", "min": "min", "max": "max", "value_count": "count"}


def from_request(df: DataFrame, request: Request | Mapping[str, Any], *, by: Sequence[str] = (), **settings: Any) -> DataFrame:
    """Clusters as a request in JSON form asks for them, with its sub-aggregations (see subaggs): those that cells can be put together from are."""
    if not isinstance(request, Request):
        request = Request.parse(request)
    metrics: dict[str, tuple[str, str]] = {}
    aggs: dict[str, Any] = {}
    for name, spec in (request.aggs or {}).items():
        kind, body, _ = parse(name, spec)
        if kind in _SIMPLE and body.get("missing") is None:
            metrics[name] = (_SIMPLE[kind], body["field"])
        else:
            aggs[name] = spec
    p = request.params
    return geo_point_clustering(df, request.field, zoom=p.zoom, radius=p.radius, ratio=p.ratio, extent=p.extent, size=p.size, shard_size=p.shard_size, by=by, metrics=metrics, aggs=aggs, missing=request.missing, **settings)
