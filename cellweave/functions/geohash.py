"""Points, cells and distances as built-in column expressions.

A point is stored as two 32-bit numbers, steps of 180 and 360 degrees over 2^32 from the equator and the meridian.  A cell is
a signed 64-bit key: the first 5 * level bits of longitude and latitude interleaved, longitude first, and the level in the
last four bits.  Its sign is kept: keys are ordered as signed numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAT_STEP, LON_STEP = 180.0 / (1 << 32), 360.0 / (1 << 32)
EARTH_RADIUS_METRES = 6_371_008.7714
#: Fixed value: the letters of geohash.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
_HALF = 1 << 31
_LOW = (1 << 32) - 1
#: Steps that spread 32 bits to every second of 64: shift, then mask.
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def quantise(degrees: Column, step: float) -> Column:
    """Steps from zero, rounded down; the upper end of the range counts to the last step."""
    return F.least(F.floor(degrees / F.lit(step)), F.lit(_HALF - 1)).cast("bigint")


def quantise_lat(lat: Column) -> Column:
    return quantise(lat, LAT_STEP)


def quantise_lon(lon: Column) -> Column:
    return quantise(lon, LON_STEP)


def degrees_lat(steps: Column) -> Column:
    return steps * F.lit(LAT_STEP)


def degrees_lon(steps: Column) -> Column:
    return steps * F.lit(LON_STEP)


def _spread(x: Column) -> Column:
    for shift, mask in _SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _gather(x: Column) -> Column:
    x = x.bitwiseAND(F.lit(_SPREAD[-1][1]))
    masks = [m for _, m in _SPREAD[-2::-1]] + [_LOW]
    for (shift, _), mask in zip(_SPREAD[::-1], masks):
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
    return x


def cell(lat_steps: Column, lon_steps: Column, level: int) -> Column:
    """Key of the cell that holds a stored point."""
    if not 0 <= level <= 12:
        raise ValueError("level must be from 0 to 12")
    if level == 0:
        return F.when(lat_steps.isNotNull() & lon_steps.isNotNull(), F.lit(0).cast("bigint"))
    bits = F.shiftleft(_spread(lon_steps + F.lit(_HALF)), 1).bitwiseOR(_spread(lat_steps + F.lit(_HALF)))
    return F.shiftleft(F.shiftrightunsigned(bits, 64 - 5 * level), 4).bitwiseOR(F.lit(level).cast("bigint"))


def with_cell(df: DataFrame, lat_steps: str, lon_steps: str, level: int, name: str) -> DataFrame:
    """df with cell() of two columns, a projection a step: no step's expression is written out twice in the next."""
    if not 0 < level <= 12:
        return df.withColumn(name, cell(F.col(lat_steps), F.col(lon_steps), level))
    x, y = f"{name}_x", f"{name}_y"
    df = df.withColumns({x: F.col(lon_steps) + F.lit(_HALF), y: F.col(lat_steps) + F.lit(_HALF)})
    for shift, mask in _SPREAD:
        df = df.withColumns({c: F.col(c).bitwiseOR(F.shiftleft(F.col(c), shift)).bitwiseAND(F.lit(mask)) for c in (x, y)})
    bits = F.shiftleft(F.col(x), 1).bitwiseOR(F.col(y))
    return df.withColumn(name, F.shiftleft(F.shiftrightunsigned(bits, 64 - 5 * level), 4).bitwiseOR(F.lit(level).cast("bigint"))).drop(x, y)


def same_cell(lat1: Column, lon1: Column, lat2: Column, lon2: Column, level: int) -> Column:
    """Whether cell() of two stored points is the same, told from the bits that it keeps, after the first of its steps."""
    n = 5 * level
    shift, mask = _SPREAD[0]

    def kept(steps: Column, bits: int) -> Column:
        first = (1 << 32) - (1 << (32 - bits))
        x = steps + F.lit(_HALF)
        return x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit((first | first << shift) & mask).cast("bigint"))

    return (kept(lat1, n // 2) == kept(lat2, n // 2)) & (kept(lon1, (n + 1) // 2) == kept(lon2, (n + 1) // 2))


def geohash(key: Column, level: int) -> Column:
    """The key as text."""
    if level == 0:
        return F.when(key.isNotNull(), F.lit(""))
    bits = F.shiftrightunsigned(key, 4)
    return F.concat(*[F.substring(F.lit(ALPHABET), (F.shiftrightunsigned(bits, 5 * (level - 1 - i)).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(level)])


def corner(key: Column, level: int) -> tuple[Column, Column]:
    """Latitude and longitude of the cell's lower left corner."""
    if level == 0:
        return F.lit(-90.0), F.lit(-180.0)
    bits = F.shiftleft(F.shiftrightunsigned(key, 4), 64 - 5 * level)
    lat = _gather(bits) - F.lit(_HALF)
    lon = _gather(F.shiftrightunsigned(bits, 1)) - F.lit(_HALF)
    return degrees_lat(lat), degrees_lon(lon)


def pack(lat_steps: Column, lon_steps: Column) -> Column:
    """Both numbers in one: latitude in the upper half."""
    return F.shiftleft(lat_steps, 32).bitwiseOR(lon_steps.bitwiseAND(F.lit(_LOW)))


def unpack_lat(packed: Column) -> Column:
    return F.shiftright(packed, 32)


def unpack_lon(packed: Column) -> Column:
    return F.shiftright(F.shiftleft(packed, 32), 32)


def arc_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the sphere (haversine)."""
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return F.lit(2 * EARTH_RADIUS_METRES) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def radius_at(radius_metres: float, lat1: Column, lat2: Column) -> Column:
    """The radius at the mean latitude of two points: pixels cover less ground away from the equator."""
    return F.lit(float(radius_metres)) * F.cos(F.radians((lat1 + lat2) / 2))
