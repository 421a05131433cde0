"""Web-map arithmetic as columns: Mercator, tile numbers and bounds, terrain colours, coordinate zones."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0
SHIFT = math.pi * RADIUS


def lonlat_to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    x = lon * SHIFT / 180.0
    y = F.ln(F.tan((lat + 90.0) * math.pi / 360.0)) / (math.pi / 180.0) * SHIFT / 180.0
    return x, y


def mercator_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    lat = y / SHIFT * 180.0
    return x / SHIFT * 180.0, 180.0 / math.pi * (2.0 * F.atan(F.exp(lat * math.pi / 180.0)) - math.pi / 2.0)


def tiles_across(z: Column) -> Column:
    return F.pow(F.lit(2.0), z.cast("double"))


def lonlat_to_tile(lon: Column, lat: Column, z: Column) -> tuple[Column, Column]:
    """XYZ tile numbers, held to 0..2^z - 1."""
    n = tiles_across(z)
    rad = lat * (math.pi / 180.0)
    y = (1.0 - F.ln(F.tan(rad) + 1.0 / F.cos(rad)) / math.pi) / 2.0 * n
    hold = lambda v: F.least(F.greatest(F.floor(v), F.lit(0)), n.cast("long") - 1).cast("int")
    return hold((lon + 180.0) / 360.0 * n), hold(y)


def tile_bounds(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column, Column]:
    """Web Mercator bounds (minx, miny, maxx, maxy) of an XYZ tile."""
    size = 2.0 * SHIFT / tiles_across(z)
    return x * size - SHIFT, SHIFT - (y + 1) * size, (x + 1) * size - SHIFT, SHIFT - y * size


def tile_range(minx: Column, miny: Column, maxx: Column, maxy: Column, z: Column) -> tuple[Column, Column, Column, Column]:
    """Tile numbers (minx, miny, maxx, maxy) that Mercator bounds touch, held to the map."""
    n = tiles_across(z)
    size = 2.0 * SHIFT / n
    hold = lambda v: F.least(F.greatest(F.floor(v), F.lit(0)), n.cast("long") - 1).cast("int")
    return hold((minx + SHIFT) / size), hold((SHIFT - maxy) / size), hold((maxx + SHIFT) / size), hold((SHIFT - miny) / size)


def terrain_code(h: Column, encoding: str = "mapbox", nodata: float | None = -9999.0) -> Column:
    """24-bit code of a height; nodata, NaN and infinity count as 0 metres."""
    odd = F.isnan(h) | (F.abs(h) == float("inf"))
    if nodata is not None:
        odd = odd | (h == F.lit(float(nodata)))
    v = F.when(odd, 0.0).otherwise(h)
    if encoding == "terrarium":
        return F.floor(F.least(F.greatest((v + 32768.0), F.lit(0.0)), F.lit(65535.99609375)) * 256.0).cast("long")
    return F.least(F.greatest(F.floor((v + 10000.0) / 0.1), F.lit(0)), F.lit((1 << 24) - 1)).cast("long")


def terrain_rgb(h: Column, encoding: str = "mapbox", nodata: float | None = -9999.0) -> tuple[Column, Column, Column]:
    code = terrain_code(h, encoding, nodata)
    part = lambda k: F.shiftright(code, k).bitwiseAND(F.lit(255)).cast("int")
    return part(16), part(8), part(0)


def terrain_decode(r: Column, g: Column, b: Column, encoding: str = "mapbox") -> Column:
    if encoding == "terrarium":
        return r * 256.0 + g + b / 256.0 - 32768.0
    return -10000.0 + (r * 65536.0 + g * 256.0 + b) * 0.1


def terrain_code_fast(h: Column) -> Column:
    """The truncating variant of the mapbox code, (h + 10000) * 10."""
    return F.least(F.greatest(((h + 10000.0) * 10.0).cast("long"), F.lit(0)), F.lit((1 << 24) - 1)).cast("long")


def cgcs2000_zone(lon: Column) -> Column:
    """Number of the 3-degree zone whose middle is nearest; null outside zones 25 to 45."""
    zone = F.floor((lon + 1.5) / 3.0).cast("int")
    return F.when((zone >= 25) & (zone <= 45), zone)


def cgcs2000_epsg(lon: Column, with_prefix: bool = False) -> Column:
    """EPSG code of that zone: 4513 to 4533 with the zone in front of eastings, 4534 to 4554 without."""
    return cgcs2000_zone(lon) + (4513 - 25 if with_prefix else 4534 - 25)


def utm_zone(lon: Column) -> Column:
    return F.least(F.floor((lon + 180.0) / 6.0) + 1, F.lit(60)).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)
