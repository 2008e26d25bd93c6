"""Map projections as column expressions: spherical web mercator and Albers equal-area conic.

Formulas: J. P. Snyder, "Map Projections - A Working Manual", USGS Professional Paper 1395 (1987).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from overgrid.model import EARTH_RADIUS


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * EARTH_RADIUS


#: Latitude of the square world's top; beyond it the projection leaves the square, at the pole it has no value.
MAX_LATITUDE = math.degrees(2 * math.atan(math.exp(math.pi)) - math.pi / 2)


def mercator_y(lat: Column) -> Column:
    """Latitudes beyond the square world are taken as its border."""
    held = F.least(F.greatest(lat, F.lit(-MAX_LATITUDE)), F.lit(MAX_LATITUDE))
    lat = F.when(F.isnan(lat), lat).otherwise(held)
    return F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * EARTH_RADIUS


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / EARTH_RADIUS)


def mercator_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.exp(y / EARTH_RADIUS)) * 2 - math.pi / 2)


@dataclass(frozen=True)
class Albers:
    """Equal-area conic on an ellipsoid; the defaults are the conterminous-US conic on GRS80."""

    lat_1: float = 29.5
    lat_2: float = 45.5
    lat_0: float = 23.0
    lon_0: float = -96.0
    semi_major: float = 6378137.0
    inverse_flattening: float = 298.257222101

    @property
    def e2(self) -> float:
        f = 1 / self.inverse_flattening
        return f * (2 - f)

    def _m2(self, lat: float) -> float:
        s = math.sin(math.radians(lat))
        return math.cos(math.radians(lat)) ** 2 / (1 - self.e2 * s * s)

    def _q(self, lat: float) -> float:
        e, s = math.sqrt(self.e2), math.sin(math.radians(lat))
        return (1 - self.e2) * (s / (1 - self.e2 * s * s) + math.atanh(e * s) / e)

    @property
    def n(self) -> float:
        return (self._m2(self.lat_1) - self._m2(self.lat_2)) / (self._q(self.lat_2) - self._q(self.lat_1))

    @property
    def c(self) -> float:
        return self._m2(self.lat_1) + self.n * self._q(self.lat_1)

    @property
    def rho_0(self) -> float:
        return self.semi_major * math.sqrt(self.c - self.n * self._q(self.lat_0)) / self.n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        e = math.sqrt(self.e2)
        s = F.sin(F.radians(lat))
        q = (s / (1 - s * s * self.e2) + F.log((1 + s * e) / (1 - s * e)) / (2 * e)) * (1 - self.e2)
        rho = F.sqrt(self.c - q * self.n) * (self.semi_major / self.n)
        theta = F.radians(lon - self.lon_0) * self.n
        return rho * F.sin(theta), self.rho_0 - rho * F.cos(theta)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        e2, e = self.e2, math.sqrt(self.e2)
        dy = self.rho_0 - y
        rho2 = x * x + dy * dy
        theta = F.atan2(x, dy)
        q = (self.c - rho2 * (self.n / self.semi_major) ** 2) / self.n
        q_pole = 1 - (1 - e2) / (2 * e) * math.log((1 - e) / (1 + e))
        beta = F.asin(q / q_pole)
        lat = (
            beta
            + F.sin(beta * 2) * (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040)
            + F.sin(beta * 4) * (23 * e2**2 / 360 + 251 * e2**3 / 3780)
            + F.sin(beta * 6) * (761 * e2**3 / 45360)
        )
        # one Newton step takes the series to full precision
        s = F.sin(lat)
        w = 1 - s * s * e2
        lat = lat + w * w / (F.cos(lat) * 2) * (q / (1 - e2) - s / w + F.log((1 - s * e) / (1 + s * e)) / (2 * e))
        return F.degrees(theta / self.n) + self.lon_0, F.degrees(lat)

    def forward_sphere(self, lon: Column, lat: Column, radius: float = EARTH_RADIUS) -> tuple[Column, Column]:
        s1, s2, s0 = (math.sin(math.radians(v)) for v in (self.lat_1, self.lat_2, self.lat_0))
        n = (s1 + s2) / 2
        c = math.cos(math.radians(self.lat_1)) ** 2 + 2 * n * s1
        rho_0 = radius * math.sqrt(c - 2 * n * s0) / n
        rho = F.sqrt(c - F.sin(F.radians(lat)) * (2 * n)) * (radius / n)
        theta = F.radians(lon - self.lon_0) * n
        return rho * F.sin(theta), rho_0 - rho * F.cos(theta)
