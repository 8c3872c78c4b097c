"""Places: rows (key, member, cell)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.functions import geo as G


def geoadd(rows: DataFrame) -> DataFrame:
    """(key, member, cell) of rows with lon, lat; places out of bounds are left out."""
    return rows.where(G.valid(F.col("lon"), F.col("lat"))).select("key", "member", G.cell(F.col("lon"), F.col("lat")).alias("cell"))


def geopos(cells: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """(key, member, lon, lat) of cells' centres, null for requests that are missing."""
    lon, lat = G.centre(F.col("cell"))
    found = cells.select("key", "member", lon.alias("lon"), lat.alias("lat"))
    return found if requests is None else requests.join(found, ["key", "member"], "left")


def geodist(cells: DataFrame, pairs: DataFrame, unit: str = "m") -> DataFrame:
    """pairs (key, a, b) with ``dist`` between centres; null if one is missing."""
    at = geopos(cells)
    a = at.select("key", F.col("member").alias("a"), F.col("lon").alias("lon_a"), F.col("lat").alias("lat_a"))
    b = at.select("key", F.col("member").alias("b"), F.col("lon").alias("lon_b"), F.col("lat").alias("lat_b"))
    metres = G.distance(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b"))
    return pairs.join(a, ["key", "a"], "left").join(b, ["key", "b"], "left").select("key", "a", "b", G.in_unit(metres, unit).alias("dist"))


def georadius(cells: DataFrame, lon: float, lat: float, metres: float) -> DataFrame:
    """Members within the radius with ``dist`` in metres; a band of latitudes goes first."""
    at = geopos(cells)
    band = math.degrees(metres / G.RADIUS) + 1e-6
    dist = G.distance(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat"))
    near = at.where(F.col("lat").between(lat - band, lat + band))
    return near.withColumn("dist", dist).where(F.col("dist") <= metres)


def georadius_by_member(cells: DataFrame, key: str, member: str, metres: float) -> DataFrame:
    """Members within the radius of another; the centre is one row, so its broadcast is bounded."""
    at = geopos(cells.where(F.col("key") == key))
    centre = at.where(F.col("member") == member).limit(1).select(F.col("lon").alias("lon0"), F.col("lat").alias("lat0"))
    dist = G.distance(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat"))
    return at.crossJoin(F.broadcast(centre)).withColumn("dist", dist).where(F.col("dist") <= metres).drop("lon0", "lat0")
