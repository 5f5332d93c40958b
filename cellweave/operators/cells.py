"""From rows to cells: values, cells, counts, centroids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geohash as g
from ..sources import points as p

#: Metrics that can be put together from those of cells.
METRICS = ("sum", "min", "max", "count", "avg")


#: Points as they are stored and put in order: steps of latitude, and of longitude without a sign.
_STORED = "struct<lat:bigint,lon:bigint>"


def _stored(point: Column) -> Column:
    return F.struct(g.quantise_lat(point["lat"]).alias("lat"), g.quantise_lon(point["lon"]).bitwiseAND(F.lit((1 << 32) - 1)).alias("lon"))


def _celled(df: DataFrame, stored: str, level: int) -> DataFrame:
    """df with __lat, __lon and __cell of a stored point, which is known to be one."""
    return _with_cell(df, *_signed(stored), level)


def _with_cell(df: DataFrame, lat: Column, lon: Column, level: int) -> DataFrame:
    """df with __lat, __lon and __cell of steps that aren't null, in columns that can't be: a join on the cell would else test it in every row, by an expression that has all steps of the key, and all of the point's own, written out many times."""
    df = df.withColumns({"__lat": F.coalesce(lat, F.lit(0).cast("bigint")), "__lon": F.coalesce(lon, F.lit(0).cast("bigint"))})
    return g.with_cell(df, "__lat", "__lon", level, "__cell")


def _signed(stored: str) -> tuple[Column, Column]:
    return F.col(f"{stored}.lat"), F.shiftright(F.shiftleft(F.col(f"{stored}.lon"), 32), 32)


def located(df: DataFrame, field: str, level: int, missing: Any = None) -> DataFrame | None:
    """df with __cell, __lat, __lon: a row for each counted point.  None where df has no such field and nothing stands in for it.

    Points of a row are taken in order of latitude and (unsigned) longitude, those whose cell is that of the one before left out.
    """
    points, many = p.points_column(df, field)
    if missing is not None:
        substitute = F.array(p.literal(missing)) if many else p.literal(missing)
        points = substitute if points is None else F.when(F.size(points) > 0 if many else points["lat"].isNotNull(), points).otherwise(substitute)
    if points is None:
        return None
    df = df.withColumn("__point", points)
    if many:
        return without_runs(df, level).drop("__point")
    df = df.where(F.col("__point.lat").isNotNull())
    return _celled(df.withColumn("__point", _stored(F.col("__point"))), "__point", level).drop("__point")


def without_runs(df: DataFrame, level: int) -> DataFrame:
    """A row for each point of the array __point, but those in the cell of the one before.

    Each point is put beside the one before it by its place in a second array, and compared with it as a row.  A lambda that
    looks back in the array would have the array made anew for each point, when a filter on it is pushed below the projection
    that makes it; explode() infers such a filter, explode_outer() none.
    """
    df = df.withColumn("__point", F.sort_array(F.transform("__point", _stored)))
    before = F.concat(F.array(F.lit(None).cast(_STORED)), F.slice("__point", 1, F.greatest(F.size("__point") - 1, F.lit(0))))
    df = df.withColumn("__point", F.explode_outer(F.arrays_zip(F.col("__point").alias("here"), before.alias("before"))))
    again = F.col("__point.before.lat").isNotNull() & g.same_cell(*_signed("__point.here"), *_signed("__point.before"), level)
    return _celled(df.where(F.col("__point.here.lat").isNotNull() & ~again), "__point.here", level)


def located_columns(df: DataFrame, lat: str, lon: str, level: int) -> DataFrame:
    """located() of two coordinate columns, one point a row: filters on them reach the scan."""
    df = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    return _with_cell(df, g.quantise_lat(F.col(lat)), g.quantise_lon(F.col(lon)), level)


def aggregate(points: DataFrame, by: Sequence[str] = (), metrics: Mapping[str, tuple[str, str]] | None = None, weight: str | None = None) -> DataFrame:
    """A row for each cell: by, cell, doc_count, lat, lon, and the parts of metrics.  Sums of whole numbers: the same whatever the partitions.

    weight: a column of whole numbers, how many documents a row stands for (a null, or less than 1, for one); centroids follow it.
    """
    parts = []
    for name, (kind, column) in (metrics or {}).items():
        if kind not in METRICS:
            raise ValueError(f"{kind} is none of {', '.join(METRICS)}")
        value = F.col(column).cast("double")
        if kind in ("sum", "avg"):
            parts.append(F.sum(value).alias(f"{name}__sum"))
        if kind in ("count", "avg"):
            parts.append(F.count(value).cast("double").alias(f"{name}__count"))
        if kind in ("min", "max"):
            parts.append((F.min if kind == "min" else F.max)(value).alias(f"{name}__{kind}"))
    n, sums = F.count(F.lit(1)), [F.sum(x).alias(x) for x in ("__lat", "__lon")]
    if weight is not None:
        times = F.greatest(F.coalesce(F.col(weight).cast("bigint"), F.lit(1)), F.lit(1))
        n, sums = F.sum(times), [F.sum(F.col(x) * times).alias(x) for x in ("__lat", "__lon")]
    out = points.groupBy(*by, "__cell").agg(n.alias("__n"), *sums, *parts)
    lat, lon = g.degrees_lat(F.col("__lat") / F.col("__n")), g.degrees_lon(F.col("__lon") / F.col("__n"))
    return out.withColumn("__lat", lat).withColumn("__lon", lon)


def greatest(cells: DataFrame, size: int, by: Sequence[str] = ()) -> DataFrame:
    """The `size` cells of greatest key, of each group."""
    if not by:
        return cells.orderBy(F.desc("__cell")).limit(size)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("__cell")))
    return cells.withColumn("__rank", rank).where(F.col("__rank") <= size).drop("__rank")
