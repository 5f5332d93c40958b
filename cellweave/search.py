"""Whole searches: a query that chooses rows, and clusterings of them."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame

from .operators.clustering import from_request
from .operators.subaggs import predicate
from .plans.params import Request
from .sources.response import to_response


def search(df: DataFrame, body: Mapping[str, Any], **settings: Any) -> dict[str, Any]:
    """The response to {"query": {...}, "aggs": {name: {"geo_point_clustering": {...}, "aggs": {...}, "meta": {...}}}, "size": 0}.

    hits.total counts the rows that the query chooses, whether they have a point or not.  Hits themselves are not listed, so
    size must be 0 where it is given.  settings go to the clusterings.
    """
    if unknown := set(body) - {"query", "aggs", "aggregations", "size", "track_total_hits"}:
        raise ValueError(f"unknown parts: {', '.join(sorted(unknown))}")
    if body.get("size", 0):
        raise ValueError("hits are not listed: size must be 0")
    rows = df.where(predicate(body["query"])) if body.get("query") else df
    out: dict[str, Any] = {"hits": {"total": {"value": rows.count(), "relation": "eq"}, "hits": []}, "aggregations": {}}
    for name, spec in (body.get("aggs", body.get("aggregations")) or {}).items():
        request = Request.parse(spec)
        out["aggregations"] |= to_response(from_request(rows, request, **settings), name, meta=request.meta)["aggregations"]
    return out
