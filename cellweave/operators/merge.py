"""Greedy merge of cells into clusters around a moving centroid.

Cells are taken in falling order of their key.  The first that is left founds a cluster and looks at the others once, in
order: each whose distance is at most the radius at the mean latitude joins at once, and moves the cluster's centroid before
the next is looked at.  With a ratio, those that are less than ratio times too far are looked at once more at the end.  The
outcome depends on the order, so the cells of a group meet in one task; there are at most `size` of them.
"""

from __future__ import annotations

import math

import numpy as np

from ..functions.geohash import EARTH_RADIUS_METRES

def _distance(lat1: float, lon1: float, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    a, b = np.sin(np.radians(lat2 - lat1) / 2), np.sin(np.radians(lon2 - lon1) / 2)
    h = a * a + math.cos(math.radians(lat1)) * np.cos(np.radians(lat2)) * b * b
    return 2 * EARTH_RADIUS_METRES * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def _reach(radius: float, lat1: float, lat2: np.ndarray) -> np.ndarray:
    return radius * np.cos(np.radians((lat1 + lat2) / 2))


def _joined(n: int, lat: float, lon: float, k: int, y: float, x: float) -> tuple[int, float, float]:
    return n + k, (lat * n + y * k) / (n + k), (lon * n + x * k) / (n + k)


def merge_cells(count: np.ndarray, lat: np.ndarray, lon: np.ndarray, radius: float, ratio: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cluster of each cell (numbered in order of their founders), and each cluster's count and centroid.  Cells are in falling order of key."""
    n = len(count)
    cluster = np.full(n, -1, np.int64)
    out: list[tuple[int, float, float]] = []
    # a distance is at least that of the latitudes, so only a band around the centroid can matter
    north = np.argsort(lat, kind="stable")
    lat_north = lat[north]
    band = math.degrees(radius * max(1.0, ratio) / EARTH_RADIUS_METRES) * (1 + 1e-9) + 1e-9
    for seed in range(n):
        if cluster[seed] >= 0:
            continue
        mine = len(out)
        cluster[seed] = mine
        c_n, c_lat, c_lon = int(count[seed]), float(lat[seed]), float(lon[seed])
        edge: list[int] = []
        after, joined = seed, True
        while joined:
            a, b = np.searchsorted(lat_north, (c_lat - band, c_lat + band))
            look = north[a : b + 1]
            look = np.sort(look[(look > after) & (cluster[look] < 0)])
            d, r = _distance(c_lat, c_lon, lat[look], lon[look]), _reach(radius, c_lat, lat[look])
            near = d <= r
            joined = bool(near.any())
            hit = int(near.argmax()) if joined else len(look)
            if ratio > 0:
                with np.errstate(divide="ignore", invalid="ignore"):
                    edge.extend(look[:hit][(d[:hit] / r[:hit]) < ratio].tolist())
            if joined:
                after = int(look[hit])
                cluster[after] = mine
                c_n, c_lat, c_lon = _joined(c_n, c_lat, c_lon, int(count[after]), float(lat[after]), float(lon[after]))
        for i in edge:
            if _distance(c_lat, c_lon, lat[i : i + 1], lon[i : i + 1])[0] <= _reach(radius, c_lat, lat[i : i + 1])[0]:
                cluster[i] = mine
                c_n, c_lat, c_lon = _joined(c_n, c_lat, c_lon, int(count[i]), float(lat[i]), float(lon[i]))
        out.append((c_n, c_lat, c_lon))
    total, y, x = (np.array([o[i] for o in out], t) for i, t in ((0, np.int64), (1, float), (2, float)))
    return cluster, total, y, x
