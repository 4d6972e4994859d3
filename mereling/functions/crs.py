"""Coordinate systems: longitude and latitude, transverse Mercator grids (UTM, British National Grid), web Mercator.

A conversion is a list of steps, each written once for a namespace of functions: `math` for single points on the
driver, `pyspark.sql.functions` for columns, where all stays in Spark's own expressions. The transverse Mercator is the
Krueger series to the fourth power of the third flattening, good to a micrometre within a zone.
"""

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from mereling.functions.grid import let

Number = Any  # float, or a Column
Step = Callable[..., tuple]  # (math or Spark's functions, values) to values


@dataclass(frozen=True)
class Ellipsoid:
    """Semi-major axis and flattening, and a shift of its datum to WGS 84: metres, seconds of arc, parts per million."""

    a: float
    f: float
    shift: tuple[float, float, float, float, float, float, float] | None = None

    @property
    def n(self) -> float:
        return self.f / (2 - self.f)

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)


# Axes and flattenings, the published shift of the British datum, and the grid's parameters.
WGS84 = Ellipsoid(6378137.0, 1 / 298.257223563)
AIRY = Ellipsoid(6377563.396, 1 - 6356256.909 / 6377563.396, (446.448, -125.157, 542.060, 0.1502, 0.2470, 0.8421, -20.4894))


def _series(c1: float, c2: float, c3: float, c4: float) -> list[Step]:
    """p + iq with the sum of c_j sin(2j(p + iq)) added, by Clenshaw's recurrence in a = 2 cos(2(p + iq))."""
    return [
        lambda m, p, q: (p, q, 2 * m.cos(2 * p) * m.cosh(2 * q), -2 * m.sin(2 * p) * m.sinh(2 * q), m.sin(2 * p) * m.cosh(2 * q), m.cos(2 * p) * m.sinh(2 * q)),
        lambda m, p, q, ar, ai, sr, si: (p, q, ar, ai, sr, si, c3 + ar * c4, ai * c4),
        lambda m, p, q, ar, ai, sr, si, r3, i3: (p, q, ar, ai, sr, si, r3, i3, c2 - c4 + ar * r3 - ai * i3, ar * i3 + ai * r3),
        lambda m, p, q, ar, ai, sr, si, r3, i3, r2, i2: (p, q, sr, si, c1 + ar * r2 - ai * i2 - r3, ar * i2 + ai * r2 - i3),
        lambda m, p, q, sr, si, r, i: (p + sr * r - si * i, q + sr * i + si * r),
    ]


@dataclass(frozen=True)
class TransverseMercator:
    ellipsoid: Ellipsoid
    lon0: float
    lat0: float
    scale: float
    east: float
    north: float

    @property
    def _radius(self) -> float:
        n = self.ellipsoid.n
        return self.scale * self.ellipsoid.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    @property
    def _alpha(self) -> tuple[float, ...]:
        n = self.ellipsoid.n
        return n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280

    def _sphere(self) -> list[Step]:
        """Radians from the meridian to the conformal sphere's transverse coordinates, north and east."""
        e = math.sqrt(self.ellipsoid.e2)
        return [
            lambda m, lon, lat: (lon, m.sinh(m.asinh(m.tan(lat)) - e * m.atanh(e * m.sin(lat)))),
            lambda m, lon, t: (m.atan2(t, m.cos(lon)), m.atanh(m.sin(lon) / m.sqrt(1 + t * t))),
        ]

    @property
    def _base(self) -> float:
        """The series' north of the grid's origin."""
        return run([*self._sphere(), *_series(*self._alpha)], 0.0, math.radians(self.lat0))[0]

    def forward(self) -> list[Step]:
        """Degrees on the ellipsoid to metres east and north."""
        radius, base = self._radius, self._base
        place = lambda m, north, east: (self.east + radius * east, self.north + radius * (north - base))
        return [lambda m, lon, lat: (m.radians(lon - self.lon0), m.radians(lat)), *self._sphere(), *_series(*self._alpha), place]

    def inverse(self) -> list[Step]:
        """Metres east and north to degrees on the ellipsoid."""
        n, radius, base = self.ellipsoid.n, self._radius, self._base
        beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
        delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
        d1, d2, d3, d4 = delta
        return [
            lambda m, x, y: ((y - self.north) / radius + base, (x - self.east) / radius),
            *_series(*(-c for c in beta)),
            lambda m, p, q: (self.lon0 + m.degrees(m.atan2(m.sinh(q), m.cos(p))), m.asin(m.sin(p) / m.cosh(q))),
            lambda m, lon, c: (lon, c, 2 * m.cos(2 * c), m.sin(2 * c)),
            lambda m, lon, c, a, s: (lon, c, a, s, d3 + a * d4),
            lambda m, lon, c, a, s, b3: (lon, c + s * (d1 + a * (d2 + a * b3 - d4) - b3)),
            lambda m, lon, lat: (lon, m.degrees(lat)),
        ]


@dataclass(frozen=True)
class WebMercator:
    ellipsoid: Ellipsoid = WGS84

    def forward(self) -> list[Step]:
        return [lambda m, lon, lat: (self.ellipsoid.a * m.radians(lon), self.ellipsoid.a * m.asinh(m.tan(m.radians(lat))))]

    def inverse(self) -> list[Step]:
        return [lambda m, x, y: (m.degrees(x / self.ellipsoid.a), m.degrees(m.atan(m.sinh(y / self.ellipsoid.a))))]


@dataclass(frozen=True)
class Degrees:
    ellipsoid: Ellipsoid = WGS84

    def forward(self) -> list[Step]:
        return []

    inverse = forward


def normal(name: str | None) -> str:
    """`EPSG:n` from a name or URN; longitude and latitude (EPSG:4326) where a layer names no system."""
    if not name or "CRS84" in name.upper():
        return "EPSG:4326"
    code = re.search(r"(\d+)\s*$", name)
    if not code:
        raise ValueError(f"no EPSG code in {name!r}")
    return f"EPSG:{int(code[1])}"


def system(name: str | None) -> Degrees | TransverseMercator | WebMercator:
    """The system of an EPSG code: 4326, 3857, 27700, or a UTM zone on WGS 84."""
    code = int(normal(name)[5:])
    if code == 4326:
        return Degrees()
    if code == 3857:
        return WebMercator()
    if code == 27700:
        return TransverseMercator(AIRY, -2.0, 49.0, 0.9996012717, 400000.0, -100000.0)
    if code // 100 in (326, 327) and 1 <= code % 100 <= 60:
        return TransverseMercator(WGS84, 6.0 * (code % 100) - 183, 0.0, 0.9996, 500000.0, 0.0 if code // 100 == 326 else 10_000_000.0)
    raise ValueError(f"EPSG:{code} isn't among the systems known here: 4326, 3857, 27700, 32601-32660, 32701-32760")


def _shifted(source: Ellipsoid, target: Ellipsoid) -> list[Step]:
    """Degrees from one ellipsoid's datum to another's, at height 0."""
    shift, sign = (source.shift, 1) if source.shift else (target.shift, -1)
    tx, ty, tz = (sign * v for v in shift[:3])
    rx, ry, rz = (sign * math.radians(v / 3600) for v in shift[3:6])
    k, b = 1 + sign * shift[6] * 1e-6, target.a * (1 - target.f)
    return [
        lambda m, lon, lat: (m.radians(lon), m.radians(lat)),
        lambda m, lon, lat: (lon, lat, source.a / m.sqrt(1 - source.e2 * m.sin(lat) * m.sin(lat))),
        lambda m, lon, lat, nu: (nu * m.cos(lat) * m.cos(lon), nu * m.cos(lat) * m.sin(lon), (1 - source.e2) * nu * m.sin(lat)),
        lambda m, x, y, z: (tx + k * x - rz * y + ry * z, ty + rz * x + k * y - rx * z, tz - ry * x + rx * y + k * z),
        lambda m, x, y, z: (m.degrees(m.atan2(y, x)), z, m.sqrt(x * x + y * y)),
        lambda m, lon, z, p: (lon, z, p, m.atan2(z * target.a, p * b)),
        lambda m, lon, z, p, u: (lon, z + (target.a**2 - b**2) / b * m.sin(u) * m.sin(u) * m.sin(u), p - target.e2 * target.a * m.cos(u) * m.cos(u) * m.cos(u)),
        lambda m, lon, y, x: (lon, m.degrees(m.atan2(y, x))),
    ]


def steps(source: str, target: str) -> list[Step]:
    """What takes (x, y) of one system to another, in order; nothing where they are the same."""
    if normal(source) == normal(target):
        return []
    a, b = system(source), system(target)
    return [*a.inverse(), *(_shifted(a.ellipsoid, b.ellipsoid) if a.ellipsoid != b.ellipsoid else []), *b.forward()]


def run(todo: list[Step], *values: float) -> tuple[float, ...]:
    """Steps on plain numbers."""
    for step in todo:
        values = step(math, *values)
    return values


def convert(x: float, y: float, source: str, target: str) -> tuple[float, float]:
    """One point in another system."""
    return run(steps(source, target), x, y)


def point(x: Column, y: Column, source: str, target: str) -> Column:
    """A point in another system, as a struct (x, y). Each step's values are bound once, so formulas don't multiply."""
    pack = lambda values: F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values)))
    apply = lambda step, n: lambda s: pack(step(F, *(s[f"v{i}"] for i in range(n))))
    value, n = pack((x.cast("double"), y.cast("double"))), 2
    for step in steps(source, target):
        value, n = let(value, apply(step, n)), len(step(F, *(F.lit(0.0) for _ in range(n))))
    return let(value, lambda s: F.struct(s["v0"].alias("x"), s["v1"].alias("y")))


def points(vertices: Column, source: str, target: str) -> Column:
    """An array of (x, y) in another system."""
    if normal(source) == normal(target):
        return vertices
    return F.transform(vertices, lambda v: point(v["x"], v["y"], source, target))


def bounds(left: float, bottom: float, right: float, top: float, source: str, target: str, steps: int = 21) -> tuple[float, float, float, float]:
    """A box of another system that holds the box: its edges bend, so each is followed at `steps` places."""
    along = [i / (steps - 1) for i in range(steps)]
    edge = [(left + t * (right - left), y) for t in along for y in (bottom, top)] + [(x, bottom + t * (top - bottom)) for t in along for x in (left, right)]
    moved = [convert(x, y, source, target) for x, y in edge]
    xs, ys = zip(*moved, strict=True)
    return min(xs), min(ys), max(xs), max(ys)
