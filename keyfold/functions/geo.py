"""Grid cells and distances on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of longitude and latitude, bits of each in a cell, the Earth's radius (m),
# metres in each unit and the decimals that it is given with.
MAX_LON, MAX_LAT = 180.0, 85.05112878
BITS = 26
RADIUS = 6372797.5
UNITS = {"m": (1.0, 2), "km": (1000.0, 4), "mi": (1609.34, 4), "ft": (0.3048, 2)}


def valid(lon: Column, lat: Column) -> Column:
    return lon.between(-MAX_LON, MAX_LON) & lat.between(-MAX_LAT, MAX_LAT)


def _step(x: Column, limit: float) -> Column:
    cells = 1 << BITS
    return F.least(F.floor((x + limit) / (2 * limit) * cells), F.lit(cells - 1)).cast("long")


def cell(lon: Column, lat: Column) -> Column:
    """52 bits, longitude's and latitude's steps interleaved, longitude's bit first."""
    return F.shiftleft(_spread(_step(lon, MAX_LON)), 1).bitwiseOR(_spread(_step(lat, MAX_LAT)))


def _spread(x: Column) -> Column:
    """The bits of x at every second place: its binary digits read in base four."""
    return F.conv(F.bin(x), 4, 10).cast("long")


def _every_second(x: Column) -> Column:
    """The bits of x at even places: base-four digits, all 0 or 1, read as binary."""
    even = x.bitwiseAND(F.lit(0x5555555555555555)).cast("string")
    return F.conv(F.conv(even, 10, 4), 2, 10).cast("long")


def centre(c: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a cell's centre."""
    cells = float(1 << BITS)
    lon = (_every_second(F.shiftright(c, 1)) + 0.5) / cells * (2 * MAX_LON) - MAX_LON
    lat = (_every_second(c) + 0.5) / cells * (2 * MAX_LAT) - MAX_LAT
    return lon, lat


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres by the haversine formula."""
    u = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    v = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    a = F.pow(u, 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(v, 2)
    return F.lit(2 * RADIUS) * F.asin(F.when(a > 1, F.lit(1.0)).otherwise(F.sqrt(a)))


def in_unit(metres: Column, unit: str) -> Column:
    if unit not in UNITS:
        raise ValueError(f"unsupported unit {unit!r}: m, km, mi, ft")
    per, decimals = UNITS[unit]
    return F.round(metres / per, decimals)


#: Digits of the text form of a cell.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(lon: Column, lat: Column) -> Column:
    """The common text form of a place: 11 digits of five bits, latitude over -90 to 90."""
    c = F.shiftleft(_spread(_step(lon, 180.0)), 1).bitwiseOR(_spread(_step(lat, 90.0)))
    digits = [F.substr(F.lit(BASE32), F.call_function("shiftright", c, F.lit(47 - 5 * i)).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for i in range(10)]
    return F.concat(*digits, F.lit("0"))
