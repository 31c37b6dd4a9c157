"""Places: leader clusters with moving centres, and their names."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnowlane.functions.capture import EARTH_KM, haversine_km, position_label
from winnowlane.operators.order import fold_units
from winnowlane.scratch import parts


def _km(lat: float, lon: float, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    a = np.sin(np.radians(lats - lat) / 2) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(lats)) * np.sin(np.radians(lons - lon) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def _km_one(lat: float, lon: float, lat2: float, lon2: float) -> float:
    """The same by the C library's functions, as databases take them: numpy's may differ in the last bit, which decides between centres equally far."""
    one = math.pi / 180
    x, y = math.sin((lat - lat2) * one / 2), math.sin((lon - lon2) * one / 2)
    return 2 * EARTH_KM * math.asin(min(1.0, math.sqrt(x * x + math.cos(lat2 * one) * math.cos(lat * one) * (y * y))))


#: Centres up to which each point is compared with all.
FEW_CENTRES = 64


class _Grid:
    """Centres filed by cells of space of the radius' chord, so that all within the radius of a point lie in its cell or the 26 around."""

    def __init__(self, radius: float):
        self.size = 2 * np.sin(min(radius / (2 * EARTH_KM), np.pi / 2)) * (1 + 1e-9) + 1e-9
        self.cells: dict[tuple, list[int]] = {}
        self.filed: list[tuple] = []

    def cell(self, lat: float, lon: float) -> tuple:
        lat, lon = math.radians(lat), math.radians(lon)
        across = math.cos(lat)
        return tuple(math.floor(x / self.size) for x in (across * math.cos(lon), across * math.sin(lon), math.sin(lat)))

    def file(self, k: int, lat: float, lon: float) -> None:
        """File a new centre, or one whose mean has moved."""
        cell = self.cell(lat, lon)
        if k == len(self.filed):
            self.filed.append(cell)
        elif self.filed[k] == cell:
            return
        else:
            self.cells[self.filed[k]].remove(k)
            self.filed[k] = cell
        self.cells.setdefault(cell, []).append(k)

    def around(self, lat: float, lon: float) -> list[int]:
        x, y, z = self.cell(lat, lon)
        return sorted(k for i in (x - 1, x, x + 1) for j in (y - 1, y, y + 1) for m in (z - 1, z, z + 1) for k in self.cells.get((i, j, m), ()))


def leaders(lat: np.ndarray, lon: np.ndarray, radius: float, few: int = FEW_CENTRES) -> np.ndarray:
    """Cluster of each point, in order: the nearest centre within the radius, else a new one; centres are running means."""
    return np.array(_leaders(np.asarray(lat, float).tolist(), np.asarray(lon, float).tolist(), radius, few)[0], np.int64)


def _leaders(lat: list[float], lon: list[float], radius: float, few: int = FEW_CENTRES) -> tuple[list[int], list[list]]:
    """leaders(), and latitude, longitude and points of each centre.

    Means move as (mean * n + x) / (n + 1) from point to point, and the older of equally near centres holds. Beyond
    ``few`` centres a point looks at those in the cells around it only, so time follows the points, not points times centres.
    """
    out, mid = [], []
    # a position that is no number has no cell
    grid = _Grid(radius) if len(lat) > few and all(map(math.isfinite, lat)) and all(map(math.isfinite, lon)) else None
    for y, x in zip(lat, lon):
        at = range(len(mid)) if grid is None or len(mid) <= few else grid.around(y, x)
        if len(at) > FEW_CENTRES:  # the nearest by arrays, what the last bits decide one by one
            there = np.array([mid[k][:2] for k in at])
            d = _km(y, x, there[:, 0], there[:, 1])
            at = [at[i] for i in np.flatnonzero(d <= np.nanmin(d, initial=np.inf) + 1e-6).tolist()]
        best, near = -1, math.inf
        for k in at:
            d = _km_one(y, x, mid[k][0], mid[k][1]) if math.isfinite(y + x + mid[k][0] + mid[k][1]) else math.nan
            if d < near:
                best, near = k, d
        if near <= radius:
            c = mid[best]
            c[0], c[1], c[2] = (c[0] * c[2] + y) / (c[2] + 1), (c[1] * c[2] + x) / (c[2] + 1), c[2] + 1
        else:
            best = len(mid)
            mid.append([y, x, 1])
        out.append(int(best))
        if grid is not None:
            grid.file(int(best), mid[best][0], mid[best][1])
    return out, mid


def _placed(rows: DataFrame, by: str, when: str, key: str, work, schema: str) -> DataFrame:
    """work(unit, columns) over each ``by``'s rows with a position, in the order of time (missing last) and key."""
    here = rows.where("lat IS NOT NULL AND lon IS NOT NULL").select(by, key, when, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    return fold_units(here, by, [F.col(when).asc_nulls_last(), F.col(key).asc_nulls_last()], work, schema, [by, key, "lat", "lon"])


def locations(rows: DataFrame, radius_km: float, by: str, when: str = "ts", key: str = "id") -> DataFrame:
    """by, id, cluster, lat, lon of every row with a position: an order-dependent fold, one ``by`` after another in a task.

    Rows are taken in the order of time (missing last) and key. Rows without a position have no cluster.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (by, key)}

    def fold(u, c: dict[str, list]) -> dict[str, list]:
        return {by: c[by], key: c[key], "cluster": _leaders(c["lat"], c["lon"], radius_km)[0], "lat": c["lat"], "lon": c["lon"]}

    return _placed(rows, by, when, key, fold, f"{by} {kinds[by]}, {key} {kinds[key]}, cluster long, lat double, lon double")


def leader_centres(rows: DataFrame, radius_km: float, by: str, when: str = "ts", key: str = "id") -> DataFrame:
    """by, cluster, n, lat, lon of the clusters of locations(), with the running means that rows were held against."""

    def fold(u, c: dict[str, list]) -> dict[str, list]:
        mid = _leaders(c["lat"], c["lon"], radius_km)[1]
        return {by: [u] * len(mid), "cluster": list(range(len(mid))), "n": [m[2] for m in mid], "lat": [m[0] for m in mid], "lon": [m[1] for m in mid]}

    return _placed(rows, by, when, key, fold, f"{by} {rows.schema[by].dataType.simpleString()}, cluster long, n long, lat double, lon double")


def centres(located: DataFrame, by: str) -> DataFrame:
    return located.groupBy(by, "cluster").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("n"))


def nearest_within(points: DataFrame, places: DataFrame, radius_km: float, by: list[str]) -> DataFrame:
    """For each point (``by``, lat, lon) the nearest place (name, lat, lon) within the radius, ties to the first name.

    Points and places meet on cells of latitude and longitude, each place in the cells that the radius can
    reach; so it is an equi-join, not a comparison of all with all.
    """
    step = radius_km / (EARTH_KM * np.pi / 180) * 1.0001
    cell = lambda c: F.floor(F.col(c) / step)
    # degrees of longitude that the radius can span at a place's latitude and a radius beyond; all of them near a pole
    lean = F.radians(F.least(F.abs(F.col("plat")) + step, F.lit(90.0)))
    wide = F.when(F.cos(lean) > 0.01, F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(radius_km / EARTH_KM / 2)) / F.cos(lean)))) * 2 * 1.0001).otherwise(360.0)
    sky = max(1, int(360 // max(step, 1.0)))  # columns of longitude, none narrower than a degree
    col = lambda x: F.pmod(F.floor((x + 180.0) / (360.0 / sky)), F.lit(sky))
    p = points.withColumn("cell", cell("lat")).withColumn("col", col(F.col("lon")))
    q = places.select("name", F.col("lat").alias("plat"), F.col("lon").alias("plon")).withColumn("cell", F.explode(F.array(*[cell("plat") + d for d in (-1, 0, 1)])))
    first, last = F.floor((F.col("plon") - wide + 180.0) / (360.0 / sky)), F.floor((F.col("plon") + wide + 180.0) / (360.0 / sky))
    q = q.withColumn("col", F.explode(F.array_distinct(F.transform(F.sequence(first, F.least(last, first + sky - 1)), lambda i: F.pmod(i, F.lit(sky))))))
    met = p.join(q, ["cell", "col"]).withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))).where(F.col("km") <= radius_km)
    return met.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("km", "name"))).where("_n = 1").select(*by, "name", "km")


#: Places of a block of pair_distances(), and the least number of blocks, so that their pairs are work for many tasks.
PAIR_BLOCK, PAIR_BLOCKS = 512, 16


def pair_distances(places: DataFrame, by: str = "unit") -> DataFrame:
    """a, b and km of every two places (``by``, lat, lon), a < b.

    Places are dealt to blocks, and each pair of blocks is a key of an equi-join, put out as one run of rows. So ids of b come
    again after a block at most: Parquet gives up the dictionary of a column whose first page (20,000 rows) holds hardly
    an id twice, as it did with all places in a row.
    """
    places = places.where(F.col(by).isNotNull())
    blocks = places.agg(F.greatest(F.ceil(F.count("*") / PAIR_BLOCK), F.lit(PAIR_BLOCKS)).cast("int").alias("_blocks"))
    dealt = places.crossJoin(F.broadcast(blocks)).withColumn("_own", F.pmod(F.xxhash64(by), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    n = 4 * parts(places.sparkSession)
    x = dealt.select(F.col("_own").alias("_i"), F.col("_other").alias("_j"), F.col(by).alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1")).repartition(n, "_i", "_j")
    y = dealt.select(F.col("_other").alias("_i"), F.col("_own").alias("_j"), F.col(by).alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")).repartition(n, "_i", "_j")
    return x.join(y.hint("merge"), ["_i", "_j"]).where("a < b").select("a", "b", haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("km"))


def place_names(located: DataFrame, written: DataFrame, given: DataFrame, radius_km: float, by: str, key: str = "id") -> DataFrame:
    """by, id and place of each located row.

    A name written on the row holds for it. Else the cluster's: the nearest given name within the radius, the
    name written most often in it (first in time of equals: ``written`` has key, place, ord), its coordinates.
    """
    mid = centres(located, by)
    given_name = nearest_within(mid, given, radius_km, [by, "cluster"]).select(by, "cluster", F.col("name").alias("given_name"))
    own = located.join(written.where("place IS NOT NULL"), key).groupBy(by, "cluster", "place").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    most = own.groupBy(by, "cluster").agg(F.max_by("place", F.struct("n", -F.col("ord"))).alias("common"))
    named = mid.join(given_name, [by, "cluster"], "left").join(most, [by, "cluster"], "left")
    named = named.select(by, "cluster", F.coalesce("given_name", "common", position_label(F.col("lat"), F.col("lon"))).alias("cluster_place"))
    return located.join(named, [by, "cluster"]).join(written.select(key, "place"), key, "left").select(by, key, F.coalesce("place", "cluster_place").alias("place"))
