"""Parameters of a clustering, and what follows from them before any row is read."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import asdict, dataclass
from typing import Any

#: Key of a clustering in a request.
NAME = "geo_point_clustering"
MAX_ZOOM, MAX_RATIO, MAX_LEVEL = 25, 2.0, 12

# fixed values: the ellipsoid of WGS 84
EQUATOR_METRES = 2 * math.pi * 6_378_137.0
POLAR_METRES = math.pi * 6_356_752.314245


def _whole(name: str, value: Any) -> int:
    if isinstance(value, bool):
        raise ValueError(f"{name} must be a whole number")
    try:
        number = int(value)
    except (TypeError, ValueError):
        raise ValueError(f"{name} must be a whole number, not {value!r}") from None
    if not isinstance(value, str) and number != value:
        raise ValueError(f"{name} must be a whole number, not {value!r}")
    return number


@dataclass(frozen=True)
class ClusterParams:
    """zoom: map zoom; radius: in pixels; extent: pixels of a map tile; ratio: a second look at cells up to ratio times too far;
    size: cells that enter the merge at most; shard_size: checked, without effect (a cell among the greatest `size` of all is
    among the greatest of any part that holds it)."""

    zoom: int = 1
    radius: int = 40
    extent: int = 256
    ratio: float = 0.0
    size: int = 10_000
    shard_size: int | None = None

    def __post_init__(self) -> None:
        for name in ("zoom", "radius", "extent", "size"):
            object.__setattr__(self, name, _whole(name, getattr(self, name)))
        try:
            object.__setattr__(self, "ratio", float(self.ratio))
        except (TypeError, ValueError):
            raise ValueError(f"ratio must be a number, not {self.ratio!r}") from None
        if self.shard_size is not None:
            object.__setattr__(self, "shard_size", _whole("shard_size", self.shard_size))
        if not 0 <= self.zoom <= MAX_ZOOM:
            raise ValueError(f"zoom must be from 0 to {MAX_ZOOM}, not {self.zoom}")
        for name in ("radius", "extent", "size", "shard_size"):
            if (value := getattr(self, name)) is not None and value <= 0:
                raise ValueError(f"{name} must be greater than 0, not {value}")
        if not self.ratio <= MAX_RATIO:
            raise ValueError(f"ratio must be at most {MAX_RATIO:g}, not {self.ratio}")

    @property
    def metres_per_pixel(self) -> float:
        return EQUATOR_METRES / (self.extent * 2**self.zoom)

    @property
    def radius_metres(self) -> float:
        return self.radius * self.metres_per_pixel

    @property
    def level(self) -> int:
        """Geohash length whose cells are about as wide as the radius; kept from 0 to 12."""
        width = self.radius_metres / (1 + POLAR_METRES / EQUATOR_METRES)
        bits = round(math.log2(math.ceil(EQUATOR_METRES / width)))
        pairs, rest = divmod(bits, 5)
        return min(MAX_LEVEL, max(0, 2 * pairs + (rest > 0) + (rest > 3)))

    def to_spec(self) -> dict[str, Any]:
        return {k: v for k, v in asdict(self).items() if v is not None}

    @classmethod
    def from_spec(cls, spec: Mapping[str, Any]) -> ClusterParams:
        known = cls.__dataclass_fields__
        if unknown := [k for k in spec if k not in known]:
            raise ValueError(f"unknown parameters: {', '.join(map(str, unknown))}")
        return cls(**spec)


@dataclass(frozen=True)
class Request:
    """A clustering as a request asks for it: the field, its stand-in where rows lack it, parameters, sub-aggregations and notes."""

    field: str
    params: ClusterParams
    missing: Any = None
    aggs: Mapping[str, Any] | None = None
    meta: Mapping[str, Any] | None = None

    @classmethod
    def parse(cls, spec: Mapping[str, Any]) -> Request:
        """From {"geo_point_clustering": {"field": ..., ...}, "aggs": {...}, "meta": {...}} or its inner part."""
        outer: Mapping[str, Any] = spec if NAME in spec else {NAME: spec}
        if unknown := set(outer) - {NAME, "aggs", "aggregations", "meta"}:
            raise ValueError(f"unknown parts: {', '.join(sorted(unknown))}")
        inner = dict(outer[NAME])
        if not isinstance(field := inner.pop("field", None), str):
            raise ValueError("field is required")
        missing = inner.pop("missing", None)
        return cls(field, ClusterParams.from_spec(inner), missing, outer.get("aggs", outer.get("aggregations")), outer.get("meta"))

    def to_spec(self) -> dict[str, Any]:
        inner = {"field": self.field, **self.params.to_spec()} | ({"missing": self.missing} if self.missing is not None else {})
        return {NAME: inner} | ({"aggs": self.aggs} if self.aggs else {}) | ({"meta": self.meta} if self.meta else {})
