"""Trees of aggregations under a bucket, as requests have them: metrics, and buckets with aggregations of their own.

A tree is {name: {kind: {...}, "aggs": {...}}}.  Metrics of a level are one grouped aggregation.  Buckets are a grouped count by the
keys above and their own, cut to the few that are asked for before they are put into an array; what hangs under them is the
same again with one more key.  Counts and sums of a sample are scaled up at every level.

Metrics: avg, sum, min, max, value_count, stats, extended_stats, cardinality, percentiles, top_hits.  Cardinality and
percentiles are sketches, of bounded size whatever a bucket holds; {"exact": true} asks for the exact values.
Buckets: terms, histogram, date_histogram, range, filter, filters, missing.  Those without rows are left out, but for the
single ones (filter, filters, missing).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.points import bounding_box

METRICS = ("avg", "sum", "min", "max", "value_count", "stats", "extended_stats", "cardinality", "percentiles")
BUCKETS = ("terms", "histogram", "date_histogram", "range")
SINGLE = ("filter", "filters", "missing")
#: Relative accuracy of percentiles is 1 / this; the error of distinct counts.
ACCURACY, DISTINCT_ERROR = 10_000, 0.02
PERCENTS = (1, 5, 25, 50, 75, 95, 99)
_UNITS = {"minute": "minute", "1m": "minute", "hour": "hour", "1h": "hour", "day": "day", "1d": "day", "week": "week", "1w": "week", "month": "month", "1M": "month", "quarter": "quarter", "1q": "quarter", "year": "year", "1y": "year"}
_SECONDS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400}


@dataclass(frozen=True)
class Counting:
    """How rows are counted: a column of weights, and the share of all rows that was read."""

    weight: str | None = None
    share: float = 1.0

    def rows(self) -> Column:
        n = F.count(F.lit(1)) if self.weight is None else F.sum(F.greatest(F.coalesce(F.col(self.weight).cast("bigint"), F.lit(1)), F.lit(1)))
        return self.whole(n)

    def whole(self, n: Column) -> Column:
        n = F.coalesce(n, F.lit(0))
        return (n if self.share == 1 else F.round(n / self.share)).cast("bigint")

    def total(self, x: Column) -> Column:
        return x if self.share == 1 else x / self.share


def parse(name: str, spec: Mapping[str, Any]) -> tuple[str, Mapping[str, Any], Mapping[str, Any]]:
    """(kind, body, children) of one aggregation."""
    kinds = [k for k in spec if k not in ("aggs", "aggregations", "meta")]
    if len(kinds) != 1:
        raise ValueError(f"{name}: one kind of aggregation at a time")
    (kind,) = kinds
    children = spec.get("aggs", spec.get("aggregations")) or {}
    if kind not in (*METRICS, *BUCKETS, *SINGLE, "top_hits"):
        raise ValueError(f"{name}: {kind} is not supported")
    if children and kind not in (*BUCKETS, *SINGLE):
        raise ValueError(f"{name}: {kind} has no buckets to aggregate under")
    for child, inner in children.items():
        parse(f"{name}.{child}", inner)
    return kind, spec[kind], children


def _field(body: Mapping[str, Any]) -> Column:
    column = F.col(body["field"])
    return column if body.get("missing") is None else F.coalesce(column, F.lit(body["missing"]))


def metric(kind: str, body: Mapping[str, Any], counting: Counting) -> Column:
    x = _field(body)
    n, total = counting.whole(F.count(x)), counting.total(F.sum(x))
    if kind in ("avg", "min", "max"):
        return getattr(F, kind)(x)
    if kind == "sum":
        return total
    if kind == "value_count":
        return n
    if kind == "cardinality":
        return F.count_distinct(x) if body.get("exact") else F.approx_count_distinct(x, DISTINCT_ERROR)
    if kind == "percentiles":
        shares = F.array(*[F.lit(p / 100) for p in body.get("percents", PERCENTS)])
        return F.percentile(x, shares) if body.get("exact") else F.percentile_approx(x.cast("double"), shares, ACCURACY)
    parts = [n.alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("avg"), total.alias("sum")]
    if kind == "extended_stats":
        parts += [counting.total(F.sum(x * x)).alias("sum_of_squares"), F.var_pop(x).alias("variance"), F.stddev_pop(x).alias("std_deviation")]
    return F.struct(*parts)


def predicate(query: Mapping[str, Any]) -> Column:
    """A filter in request form as a column: match_all, term, terms, range, exists, ids of a geo_bounding_box, bool."""
    if len(query) != 1:
        raise ValueError("one kind of query at a time")
    ((kind, body),) = query.items()
    if kind == "match_all":
        return F.lit(True)
    if kind == "exists":
        return F.col(body["field"]).isNotNull()
    if kind == "bool":
        if unknown := set(body) - {"must", "filter", "should", "must_not", "minimum_should_match"}:
            raise ValueError(f"unknown parts of bool: {', '.join(sorted(unknown))}")
        many = lambda part: [predicate(q) for q in ([body[part]] if isinstance(body.get(part), Mapping) else body.get(part, []))]
        needed = many("must") + many("filter")
        out = F.lit(True)
        for p in needed:
            out &= p
        for p in many("must_not"):
            out &= ~p
        if should := many("should"):
            least = int(body.get("minimum_should_match", 0 if needed else 1))
            out &= sum((p.cast("int") for p in should), F.lit(0)) >= least
        return out
    ((field, value),) = body.items()
    column = F.col(field)
    if kind == "term":
        value = value["value"] if isinstance(value, Mapping) else value
        return F.coalesce(column == F.lit(value), F.lit(False))
    if kind == "terms":
        return F.coalesce(column.isin(*value), F.lit(False))
    if kind == "range":
        out = column.isNotNull()
        for how, limit in value.items():
            out &= {"gt": column > limit, "gte": column >= limit, "lt": column < limit, "lte": column <= limit}[how]
        return F.coalesce(out, F.lit(False))
    if kind == "geo_bounding_box":
        if "top_left" in value:
            (left, top), (right, bottom) = (_lon_lat(value[k]) for k in ("top_left", "bottom_right"))
        else:
            top, left, bottom, right = (value[k] for k in ("top", "left", "bottom", "right"))
        return F.coalesce(bounding_box(column["lat"], column["lon"], top=top, left=left, bottom=bottom, right=right), F.lit(False))
    raise ValueError(f"{kind} queries are not supported")


def _lon_lat(value: Any) -> tuple[float, float]:
    if isinstance(value, Mapping):
        return float(value["lon"]), float(value["lat"])
    if isinstance(value, str):
        lat, lon = value.split(",")
        return float(lon), float(lat)
    lon, lat = value
    return float(lon), float(lat)


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """left with right's other columns; nulls are keys like any other."""
    other = {k: f"__right{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(other)
    match = F.lit(True)
    for k, r in other.items():
        match &= F.col(k).eqNullSafe(F.col(r))
    return left.join(right, match, "left").drop(*other.values())


def _keyed(rows: DataFrame, kind: str, body: Mapping[str, Any], key: str) -> DataFrame:
    """rows with the key of their bucket, those without one left out."""
    if kind == "range":
        x = F.col(body["field"])
        inside = []
        for i, r in enumerate(body["ranges"]):
            low, high = r.get("from"), r.get("to")
            name = r.get("key") or f"{'*' if low is None else float(low)}-{'*' if high is None else float(high)}"
            inside.append(F.when((F.lit(True) if low is None else x >= low) & (F.lit(True) if high is None else x < high) & x.isNotNull(), F.struct(F.lit(i).alias("place"), F.lit(name).alias("key"))))
        return rows.withColumn(key, F.explode(F.array_compact(F.array(*inside))))
    x = _field(body)
    if kind == "terms":
        value = x.cast("string")
    elif kind == "histogram":
        width, offset = float(body["interval"]), float(body.get("offset", 0))
        value = F.floor((x - offset) / width) * width + offset
    elif "calendar_interval" in body:
        value = F.date_trunc(_UNITS[body["calendar_interval"]], x)
    else:
        text = str(body["fixed_interval"])
        unit = text.lstrip("0123456789")
        width = float(text.removesuffix(unit)) * _SECONDS[unit]
        value = F.timestamp_seconds(F.floor(x.cast("timestamp").cast("double") / width) * width)
    return rows.withColumn(key, value).where(F.col(key).isNotNull())


def _order(kind: str, body: Mapping[str, Any], key: str) -> list[Column]:
    order = body.get("order") or ({"_count": "desc"} if kind == "terms" else {"_key": "asc"})
    out = []
    for part in order if isinstance(order, Sequence) and not isinstance(order, str) else [order]:
        ((by, way),) = part.items()
        column = F.col({"_count": "__n", "_key": key}[by])
        out.append(column.desc() if way == "desc" else column.asc())
    return [*out, F.col(key).asc()]


def _buckets(rows: DataFrame, keys: list[str], name: str, kind: str, body: Mapping[str, Any], children: Mapping[str, Any], counting: Counting) -> DataFrame:
    """keys and `name`, an array of buckets."""
    key = f"__key{len(keys)}"
    keyed = _keyed(rows, kind, body, key)
    counted = keyed.groupBy(*keys, key).agg(counting.rows().alias("__n")).where(F.col("__n") >= int(body.get("min_doc_count", 1)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*_order(kind, body, key)))
    counted = counted.withColumn("__place", place)
    if kind == "terms":
        counted = counted.where(F.col("__place") <= int(body.get("size", 10)))
    if children:
        counted = _join(counted, tree(keyed, [*keys, key], children, counting), [*keys, key])
    shown = [F.col(key)["key"].alias("key") if kind == "range" else F.col(key).alias("key")]
    shown += [F.col("__n").alias("doc_count"), *[F.col(f"`{c}`") for c in children]]
    listed = counted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("__place").alias("place"), F.struct(*shown).alias("bucket")))).alias(name))
    return listed.withColumn(name, F.transform(name, lambda b: b["bucket"]))


def _single(rows: DataFrame, keys: list[str], kind: str, body: Any, children: Mapping[str, Any], counting: Counting) -> DataFrame:
    """keys and __bucket, of the rows that a filter lets through."""
    wanted = F.col(body["field"]).isNull() if kind == "missing" else predicate(body)
    inside = rows.where(wanted)
    out = inside.groupBy(*keys).agg(counting.rows().alias("doc_count"))
    if children:
        out = _join(out, tree(inside, keys, children, counting), keys)
    return out.select(*keys, F.struct("doc_count", *[F.col(f"`{c}`") for c in children]).alias("__bucket"))


def _top_hits(rows: DataFrame, keys: list[str], name: str, body: Mapping[str, Any]) -> DataFrame:
    """keys and `name`, an array of the first `size` rows by `sort`."""
    sort = body.get("sort", [])
    order = []
    for part in [sort] if isinstance(sort, (str, Mapping)) else sort:
        field, way = (part, "asc") if isinstance(part, str) else next(iter(part.items()))
        way = way.get("order", "asc") if isinstance(way, Mapping) else way
        order.append(F.col(field).desc_nulls_last() if way == "desc" else F.col(field).asc_nulls_last())
    source = body.get("_source") or [c for c in rows.columns if not c.startswith("__")]
    shown = F.struct(*[F.col(f"`{c}`") for c in ([source] if isinstance(source, str) else source)])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, F.xxhash64(shown)))
    first = rows.withColumn("__hit", shown).withColumn("__place", place).where(F.col("__place") <= int(body.get("size", 3)))
    listed = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__place", "__hit"))).alias(name))
    return listed.withColumn(name, F.transform(name, lambda h: h["__hit"]))


def tree(rows: DataFrame, keys: list[str], aggs: Mapping[str, Any], counting: Counting) -> DataFrame:
    """keys, and a column for each aggregation, of the rows with those keys.  aggs: specs, or aggregate columns, which are taken as they are."""
    plain, out = [], None
    parts: list[tuple[DataFrame, Column | None, str]] = []
    for name, spec in aggs.items():
        if isinstance(spec, Column):
            plain.append(spec.alias(name))
            continue
        kind, body, children = parse(name, spec)
        if kind in METRICS:
            plain.append(metric(kind, body, counting).alias(name))
        elif kind == "top_hits":
            parts.append((_top_hits(rows, keys, name, body), None, name))
        elif kind in BUCKETS:
            parts.append((_buckets(rows, keys, name, kind, body, children, counting), None, name))
        elif kind == "filters":
            whole = rows.select(*keys).distinct()
            for i, (label, query) in enumerate(body["filters"].items()):
                whole = _join(whole, _single(rows, keys, "filter", query, children, counting).withColumnRenamed("__bucket", f"__filter{i}"), keys)
            labels = list(body["filters"])
            made = F.struct(*[_or_none(whole, f"__filter{i}").alias(label) for i, label in enumerate(labels)])
            parts.append((whole.select(*keys, made.alias(name)), None, name))
        else:
            one = _single(rows, keys, kind, body, children, counting)
            parts.append((one.select(*keys, F.col("__bucket").alias(name)), _none(one), name))
    out = rows.groupBy(*keys).agg(*plain) if plain else rows.select(*keys).distinct()
    for part, instead, name in parts:
        out = _join(out, part, keys)
        if instead is not None:
            out = out.withColumn(name, F.coalesce(name, instead))
    return out.select(*keys, *[F.col(f"`{c}`") for c in aggs])


def _none(one: DataFrame) -> Column:
    """A single bucket without rows."""
    return _empty(one.schema["__bucket"].dataType)


def _or_none(df: DataFrame, column: str) -> Column:
    return F.coalesce(F.col(column), _empty(df.schema[column].dataType))


def _empty(kind) -> Column:
    return F.struct(*[(F.lit(0) if f.name == "doc_count" else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])
