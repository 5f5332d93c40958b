"""Points from the forms in which data hold them, and the filters on them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geohash as g

POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
_WKT = r"^\s*POINT\s*\(\s*(\S+)\s+(\S+)\s*\)\s*$"


def point(lat: Column, lon: Column) -> Column:
    """A point; null where either is null."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon")))


def from_array(lon_lat: Column) -> Column:
    """From [lon, lat]."""
    return point(F.get(lon_lat, F.lit(1)), F.get(lon_lat, F.lit(0)))


def from_text(text: Column) -> Column:
    """From "lat,lon", "POINT (lon lat)" or a geohash; null where it is none of these."""
    pair = F.split(text, r"\s*,\s*")
    wkt_lon, wkt_lat = (F.regexp_extract(text, "(?i)" + _WKT, i).try_cast("double") for i in (1, 2))
    by_hash = point(*_corner_of_text(F.lower(F.trim(text))))
    return F.when(F.size(pair) == 2, point(F.trim(pair[0]).try_cast("double"), F.trim(pair[1]).try_cast("double"))).when(text.rlike("(?i)" + _WKT), point(wkt_lat, wkt_lon)).otherwise(by_hash)


def _corner_of_text(text: Column) -> tuple[Column, Column]:
    """Middle of the cell that a geohash of up to 12 letters names."""
    ok = text.rlike(f"^[{g.ALPHABET}]{{1,12}}$")
    lat, lon, high, wide = F.lit(-90.0), F.lit(-180.0), 180.0, 360.0
    half_high, half_wide = [], []
    for i in range(12):  # letters take turns at three bits of longitude and two of latitude, and the other way round
        letter = F.instr(F.lit(g.ALPHABET), F.substring(text, i + 1, 1)) - 1
        bit = lambda n: F.shiftright(letter, n).bitwiseAND(F.lit(1))  # noqa: E731, B023
        three, two = bit(4) * 4 + bit(2) * 2 + bit(0), bit(3) * 2 + bit(1)
        x, y = (three, two) if i % 2 == 0 else (two, three)
        wide, high = (wide / 8, high / 4) if i % 2 == 0 else (wide / 4, high / 8)
        here = F.length(text) > i
        lon, lat = lon + F.when(here, x * F.lit(wide)).otherwise(0.0), lat + F.when(here, y * F.lit(high)).otherwise(0.0)
        half_high.append(F.lit(high / 2))
        half_wide.append(F.lit(wide / 2))
    n = F.least(F.length(text), F.lit(12)) - 1
    return F.when(ok, lat + F.get(F.array(*half_high), n)), F.when(ok, lon + F.get(F.array(*half_wide), n))


def literal(value: Any) -> Column:
    """A point given as {"lat", "lon"}, [lon, lat], (as "missing" has it) text, or a column."""
    if isinstance(value, Column):
        return point(value["lat"], value["lon"])
    if isinstance(value, dict):
        return point(F.lit(float(value["lat"])), F.lit(float(value["lon"])))
    if isinstance(value, Sequence) and not isinstance(value, str):
        return point(F.lit(float(value[1])), F.lit(float(value[0])))
    if isinstance(value, str):
        if not re.match(f"(?i){_WKT}|^[^,]+,[^,]+$|^[{g.ALPHABET}]{{1,12}}$", value.strip()):
            raise ValueError(f"no point: {value!r}")
        return from_text(F.lit(value))
    raise ValueError(f"no point: {value!r}")


def points_column(df: DataFrame, field: str) -> tuple[Column | None, bool]:
    """The field as a point, whose lat is null where a row has none, or as an array of points, and which of them; None where df has no such field."""
    head = field.split(".")[0]
    if head not in df.columns:
        return None, False
    column = F.col(field) if "." in field else F.col(f"`{field}`")
    kind = df.select(column.alias("x")).schema["x"].dataType
    many = isinstance(kind, T.ArrayType)
    inner = kind.elementType if many else kind
    if isinstance(inner, T.StructType) and {"lat", "lon"} <= set(inner.names):
        if not many:  # a struct of plain columns: those who read or test one coordinate don't carry the whole point along
            return F.struct(F.when(column["lon"].isNotNull(), column["lat"].cast("double")).alias("lat"), column["lon"].cast("double").alias("lon")), False
        one = lambda p: point(p["lat"], p["lon"])
    elif isinstance(inner, T.StringType):
        one = from_text
    elif isinstance(inner, T.ArrayType) and isinstance(inner.elementType, T.NumericType):
        one = from_array
    elif many and isinstance(inner, T.NumericType):  # a single [lon, lat]
        return from_array(column), False
    else:
        raise ValueError(f"{field} holds {kind.simpleString()}, no points")
    return (F.filter(F.transform(column, one), lambda p: p.isNotNull()) if many else one(column)), many


def bounding_box(lat: Column, lon: Column, *, top: float, left: float, bottom: float, right: float) -> Column:
    """Whether a point lies in the box, edges included, as stored; a box whose left is east of its right spans the date line."""
    y, x = g.quantise_lat(lat), g.quantise_lon(lon)
    a, b = g.quantise_lon(F.lit(float(left))), g.quantise_lon(F.lit(float(right)))
    across = (x >= a) | (x <= b) if left > right else x.between(a, b)
    return y.between(g.quantise_lat(F.lit(float(bottom))), g.quantise_lat(F.lit(float(top)))) & across


def read_points(spark, path: str, *, lat: str, lon: str, name: str = "point", format: str = "parquet", **options) -> DataFrame:
    """A table with its two coordinate columns as one point column; the others stay, and only those used are read."""
    df = spark.read.format(format).options(**options).load(path)
    return df.withColumn(name, point(F.col(lat), F.col(lon)))
