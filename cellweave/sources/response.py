"""Clusters in the form of a search response."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OWN = ("cluster_rank", "key", "key_point")


def bucket(clusters: DataFrame) -> Column:
    """A cluster as JSON text: geohash_grids, doc_count, centroid, sub-aggregations."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in clusters.columns if c not in _OWN]))


def with_json(clusters: DataFrame, name: str = "json") -> DataFrame:
    return clusters.withColumn(name, bucket(clusters))


def _plain(value: Any) -> Any:
    """A sub-aggregation's value as responses have it: buckets, a bucket with what hangs under it, several values, or one."""
    if isinstance(value, list) and value and hasattr(value[0], "asDict"):
        rows = [_bucket(v) if "doc_count" in v else v.asDict(recursive=True) for v in value]
        return {"buckets": rows} if "doc_count" in value[0] else {"hits": rows}
    if hasattr(value, "asDict"):
        if "doc_count" in value:
            return _bucket(value)
        inner = value.asDict()
        if inner and all(hasattr(v, "asDict") and "doc_count" in v for v in inner.values()):
            return {"buckets": {k: _bucket(v) for k, v in inner.items()}}
        return value.asDict(recursive=True)
    return {"value": value}


def _bucket(row: Any) -> dict[str, Any]:
    return {k: v if k in ("key", "doc_count") else _plain(v) for k, v in row.asDict().items()}


def same_result(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results have the same buckets: keys, counts and sub-aggregations.  Centroids are not compared, nor the order of the rows."""
    shown = [c for c in a.columns if c not in ("centroid", "key_point")]
    if shown != [c for c in b.columns if c not in ("centroid", "key_point")]:
        return False
    a, b = (df.select(*[F.col(f"`{c}`") for c in shown]) for df in (a, b))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def to_response(clusters: DataFrame, name: str = "clusters", *, meta: Mapping[str, Any] | None = None, total: int | None = None) -> dict[str, Any]:
    """The whole response, on the driver: at most `size` buckets.  Metrics are wrapped as {"value": ...}; total is the number of hits (search() counts them)."""
    extra = [c for c in clusters.columns if c not in (*_OWN, "geohash_grids", "doc_count", "centroid")]
    buckets = []
    for row in clusters.orderBy("cluster_rank").collect():
        out = {"geohash_grids": list(row["geohash_grids"]), "doc_count": row["doc_count"], "centroid": row["centroid"].asDict()}
        for c in extra:
            out[c] = _plain(row[c])
        buckets.append(out)
    result: dict[str, Any] = ({"meta": dict(meta)} if meta else {}) | {"buckets": buckets}
    return ({"hits": {"total": {"value": total, "relation": "eq"}, "hits": []}} if total is not None else {}) | {"aggregations": {name: result}}
