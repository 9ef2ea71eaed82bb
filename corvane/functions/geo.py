"""Geographic columns: distances, boxes, polygons, tiles and hashes."""

from __future__ import annotations

import ipaddress
import json
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.7714
UNITS = {"m": 1.0, "meters": 1.0, "km": 1000.0, "kilometers": 1000.0, "mi": 1609.344, "miles": 1609.344, "yd": 0.9144, "ft": 0.3048, "in": 0.0254, "cm": 0.01, "mm": 0.001, "nmi": 1852.0, "NM": 1852.0}
_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def metres(text: object) -> float:
    m = re.fullmatch(r"\s*([\d.]+)\s*([A-Za-z]*)\s*", str(text))
    if not m:
        raise ValueError(f"failed to parse distance [{text}]")
    return float(m[1]) * UNITS[m[2] or "m"]


def decode_geohash(text: str) -> tuple[float, float]:
    lat, lon, even = [-90.0, 90.0], [-180.0, 180.0], True
    for ch in text:
        for bit in (16, 8, 4, 2, 1):
            at = lon if even else lat
            at[0 if _BASE32.index(ch) & bit else 1] = sum(at) / 2
            even = not even
    return sum(lat) / 2, sum(lon) / 2


def point(value: object) -> tuple[float, float]:
    """(lat, lon) of an object, "lat,lon", [lon, lat], WKT or geohash."""
    if isinstance(value, dict):
        return (float(value["lat"]), float(value["lon"])) if "lat" in value else point(value["coordinates"])
    if isinstance(value, (list, tuple)):
        return float(value[1]), float(value[0])
    if m := re.fullmatch(r"\s*POINT\s*\(\s*(\S+)\s+(\S+)\s*\)", str(value), re.I):
        return float(m[2]), float(m[1])
    if "," in str(value):
        lat, lon = str(value).split(",")
        return float(lat), float(lon)
    return decode_geohash(str(value))


def ip_key(c: Column) -> Column:
    """An address as 32 hexadecimal digits that sort as addresses do; IPv4 stands under ::ffff. What is no address gives null."""
    four = F.regexp_like(c, F.lit(r"^\d{1,3}(\.\d{1,3}){3}$"))
    v4 = F.array_join(F.transform(F.split(c, r"\."), lambda x: F.lpad(F.hex(x.try_cast("int")), 2, "0")), "")
    halves = F.transform(F.split(c, "::", 2), lambda h: F.transform(F.filter(F.split(h, ":"), lambda x: x != ""), lambda x: F.lpad(F.upper(x), 4, "0")))
    left, right = F.get(halves, F.lit(0)), F.coalesce(F.get(halves, F.lit(1)), F.array().cast("array<string>"))
    v6 = F.array_join(F.concat(left, F.array_repeat(F.lit("0000"), 8 - F.size(left) - F.size(right)), right), "")
    return F.when(four, F.concat(F.lit("0" * 20 + "FFFF"), v4)).when(F.contains(c, F.lit(":")) & ~F.contains(c, F.lit(".")), v6)


def ip_bounds(text: str) -> tuple[str, str]:
    """The first and last address of one address or a CIDR block, as ``ip_key`` writes them."""
    net = ipaddress.ip_network(text, strict=False)
    shift = 0xFFFF << 32 if net.version == 4 else 0
    return f"{int(net.network_address) + shift:032X}", f"{int(net.broadcast_address) + shift:032X}"


def haversine(p: Column, lat: float | Column, lon: float | Column) -> Column:
    a, b = F.radians(p["lat"]), F.radians(F.lit(lat) if not isinstance(lat, Column) else lat)
    dx = (F.radians(F.lit(lon) if not isinstance(lon, Column) else lon) - F.radians(p["lon"])) / 2
    h = F.pow(F.sin((b - a) / 2), 2.0) + F.cos(a) * F.cos(b) * F.pow(F.sin(dx), 2.0)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def plane(p: Column, lat: float, lon: float) -> Column:
    dy = F.radians(p["lat"] - lat)
    dx = F.radians(p["lon"] - lon) * F.cos(F.radians((p["lat"] + lat) / 2))
    return EARTH_M * F.sqrt(dx * dx + dy * dy)


def in_box(p: Column, top: float, left: float, bottom: float, right: float) -> Column:
    lon = p["lon"].between(left, right) if left <= right else (p["lon"] >= left) | (p["lon"] <= right)
    return p["lat"].between(bottom, top) & lon


def in_polygon(p: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting, unrolled over the ring's edges; points on the box's outside are cut off first."""
    inside = F.lit(False)
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 == y2:
            continue
        crosses = (F.lit(y1) > p["lat"]) != (F.lit(y2) > p["lat"])
        inside = inside != (crosses & (p["lon"] < (x2 - x1) * (p["lat"] - y1) / (y2 - y1) + x1))
    lats, lons = [y for y, _ in ring], [x for _, x in ring]
    return in_box(p, max(lats), min(lons), min(lats), max(lons)) & inside


def geotile(p: Column, zoom: int) -> Column:
    n = 1 << zoom
    x = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((p["lon"] + 180.0) / 360.0 * n)))
    lat = F.radians(F.greatest(F.lit(-85.0511287798066), F.least(F.lit(85.0511287798066), p["lat"])))
    y = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((1.0 - F.log(F.tan(lat) + 1 / F.cos(lat)) / math.pi) / 2.0 * n)))
    return F.concat_ws("/", F.lit(str(zoom)), x.cast("long").cast("string"), y.cast("long").cast("string"))


def geohash(p: Column, precision: int) -> Column:
    """Base-32 hash by interleaving the bits of the two cell numbers."""
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2
    x = F.least(F.lit((1 << nx) - 1), F.floor((p["lon"] + 180.0) / 360.0 * float(1 << nx)).cast("long"))
    y = F.least(F.lit((1 << ny) - 1), F.floor((p["lat"] + 90.0) / 180.0 * float(1 << ny)).cast("long"))
    out = []
    for c in range(precision):
        v = F.lit(0).cast("long")
        for b in range(5):
            i = c * 5 + b
            cell, width, at = (x, nx, i // 2) if i % 2 == 0 else (y, ny, i // 2)
            v = v * 2 + F.shiftright(cell, width - 1 - at) % 2
        out.append(F.substring(F.lit(_BASE32), (v + 1).cast("int"), F.lit(1)))
    return F.concat(*out)


def shape_bounds(shape: object) -> tuple[float, float, float, float, list[list[tuple[float, float]]]]:
    """(top, left, bottom, right) of GeoJSON or WKT, and the outer rings of its polygons as (lat, lon)."""
    if isinstance(shape, str):
        kind = re.match(r"\s*([A-Za-z]+)", shape)[1].lower()
        numbers = [tuple(map(float, pair.split())) for pair in re.findall(r"-?[\d.]+\s+-?[\d.]+", shape)]
        if kind == "bbox" or kind == "envelope":
            left, right, top, bottom = map(float, re.findall(r"-?[\d.]+", shape))
            return top, left, bottom, right, []
        rings = [[(y, x) for x, y in numbers]] if "polygon" in kind else []
    else:
        kind = shape["type"].lower()
        flat = re.findall(r"\[\s*(-?[\d.eE+-]+)\s*,\s*(-?[\d.eE+-]+)\s*\]", json.dumps(shape.get("coordinates", [])))
        numbers = [(float(x), float(y)) for x, y in flat]
        rings = [[(y, x) for x, y in poly[0]] for poly in ([shape["coordinates"]] if kind == "polygon" else shape["coordinates"] if kind == "multipolygon" else [])]
    xs, ys = [x for x, _ in numbers], [y for _, y in numbers]
    return max(ys), min(xs), min(ys), max(xs), rings
