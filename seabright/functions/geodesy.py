"""Coordinates as Column expressions: datum shifts, projections, Web Mercator, short-range distances.

Angles are degrees, lengths metres. Every function takes and returns Columns, so positions of any number of rows are converted
inside code generation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS = 6_371_008.8
MERCATOR_RADIUS = 6_378_137.0


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    inverse_f: float

    @property
    def f(self) -> float:
        return 1 / self.inverse_f

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    @property
    def e(self) -> float:
        return math.sqrt(self.e2)

    @property
    def b(self) -> float:
        return self.a * (1 - self.f)


# Published ellipsoids.
WGS84 = Ellipsoid(6378137.0, 298.257223563)
GRS80 = Ellipsoid(6378137.0, 298.257222101)
BESSEL = Ellipsoid(6377397.155, 299.1528128)
INTERNATIONAL = Ellipsoid(6378388.0, 297.0)


@dataclass(frozen=True)
class Helmert:
    """Seven-parameter shift to WGS 84, position-vector convention: metres, arc seconds, parts per million."""

    dx: float
    dy: float
    dz: float
    rx: float = 0.0
    ry: float = 0.0
    rz: float = 0.0
    scale: float = 0.0

    def inverse(self) -> Helmert:
        return Helmert(-self.dx, -self.dy, -self.dz, -self.rx, -self.ry, -self.rz, -self.scale)

    def apply(self, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        rx, ry, rz = (math.radians(v / 3600) for v in (self.rx, self.ry, self.rz))
        m = 1 + self.scale * 1e-6
        return (
            self.dx + m * (x - rz * y + ry * z),
            self.dy + m * (rz * x + y - rx * z),
            self.dz + m * (-ry * x + rx * y + z),
        )


# Published parameters to WGS 84.
RD_TO_WGS84 = Helmert(565.2369, 50.0087, 465.658, -0.406857330322398, 0.350732676542563, -1.8703473836068, 4.0812)
ED50_TO_WGS84 = Helmert(-87.0, -98.0, -121.0)


def to_geocentric(lat: Column, lon: Column, e: Ellipsoid) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    n = e.a / F.sqrt(1 - e.e2 * F.sin(phi) * F.sin(phi))
    return n * F.cos(phi) * F.cos(lam), n * F.cos(phi) * F.sin(lam), n * (1 - e.e2) * F.sin(phi)


def from_geocentric(x: Column, y: Column, z: Column, e: Ellipsoid) -> tuple[Column, Column]:
    """Latitude and longitude by Bowring's formula; its error is far below a micrometre near the surface."""
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * e.a, p * e.b)
    s, c = F.sin(theta), F.cos(theta)
    second = e.e2 / (1 - e.e2)
    return F.degrees(F.atan2(z + second * e.b * s * s * s, p - e.e2 * e.a * c * c * c)), F.degrees(F.atan2(y, x))


def datum_shift(lat: Column, lon: Column, source: Ellipsoid, shift: Helmert, target: Ellipsoid) -> tuple[Column, Column]:
    return from_geocentric(*shift.apply(*to_geocentric(lat, lon, source)), target)


@dataclass(frozen=True)
class TransverseMercator:
    """Krueger's series in the third flattening."""

    ellipsoid: Ellipsoid
    lon0: float
    k0: float = 0.9996
    false_east: float = 500_000.0
    false_north: float = 0.0

    @classmethod
    def utm(cls, zone: int, south: bool = False, ellipsoid: Ellipsoid = WGS84) -> TransverseMercator:
        return cls(ellipsoid, zone * 6 - 183.0, false_north=10_000_000.0 if south else 0.0)

    def _series(self) -> tuple[float, list[float], list[float]]:
        n = self.ellipsoid.f / (2 - self.ellipsoid.f)
        radius = self.ellipsoid.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
        # Published coefficients of the series, to the fourth power.
        alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
        beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
        return radius * self.k0, alpha, beta

    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        radius, alpha, _ = self._series()
        e = self.ellipsoid.e
        s, lam = F.sin(F.radians(lat)), F.radians(lon - self.lon0)
        t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
        xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
        x, y = eta, xi
        for j, a in enumerate(alpha, 1):
            x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return self.false_east + radius * x, self.false_north + radius * y

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        radius, _, beta = self._series()
        eta, xi = (x - self.false_east) / radius, (y - self.false_north) / radius
        u, v = xi, eta
        for j, b in enumerate(beta, 1):
            u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        chi = F.asin(F.sin(u) / F.cosh(v))
        return F.degrees(_from_conformal(chi, self.ellipsoid.e)), self.lon0 + F.degrees(F.atan2(F.sinh(v), F.cos(u)))


def _from_conformal(chi: Column, e: float) -> Column:
    """Geodetic latitude of a conformal latitude, by the published series in e squared."""
    q = e * e
    c2 = q / 2 + 5 * q**2 / 24 + q**3 / 12 + 13 * q**4 / 360
    c4 = 7 * q**2 / 48 + 29 * q**3 / 240 + 811 * q**4 / 11520
    c6 = 7 * q**3 / 120 + 81 * q**4 / 1120
    c8 = 4279 * q**4 / 161280
    return chi + c2 * F.sin(2 * chi) + c4 * F.sin(4 * chi) + c6 * F.sin(6 * chi) + c8 * F.sin(8 * chi)


@dataclass(frozen=True)
class ObliqueStereographic:
    """Double stereographic projection: ellipsoid to conformal sphere to plane."""

    ellipsoid: Ellipsoid
    lat0: float
    lon0: float
    k0: float
    false_east: float
    false_north: float

    def _sphere(self) -> tuple[float, float, float, float]:
        e, e2, phi = self.ellipsoid.e, self.ellipsoid.e2, math.radians(self.lat0)
        s = math.sin(phi)
        radius = self.ellipsoid.a * math.sqrt(1 - e2) / (1 - e2 * s * s)
        n = math.sqrt(1 + e2 * math.cos(phi) ** 4 / (1 - e2))
        w = ((1 + s) / (1 - s) * ((1 - e * s) / (1 + e * s)) ** e) ** n
        sin_chi = (w - 1) / (w + 1)
        c = (n + s) * (1 - sin_chi) / ((n - s) * (1 + sin_chi))
        chi = math.asin((c * w - 1) / (c * w + 1))
        return radius, n, c, chi

    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        radius, n, c, chi0 = self._sphere()
        e, s = self.ellipsoid.e, F.sin(F.radians(lat))
        w = c * F.pow((1 + s) / (1 - s) * F.pow((1 - e * s) / (1 + e * s), F.lit(e)), F.lit(n))
        chi, lam = F.asin((w - 1) / (w + 1)), n * F.radians(lon - self.lon0)
        b = 1 + F.sin(chi) * math.sin(chi0) + F.cos(chi) * math.cos(chi0) * F.cos(lam)
        k = 2 * radius * self.k0 / b
        return self.false_east + k * F.cos(chi) * F.sin(lam), self.false_north + k * (F.sin(chi) * math.cos(chi0) - F.cos(chi) * math.sin(chi0) * F.cos(lam))

    def inverse(self, x: Column, y: Column, rounds: int = 6) -> tuple[Column, Column]:
        radius, n, c, chi0 = self._sphere()
        dx, dy = x - self.false_east, y - self.false_north
        rho = F.sqrt(dx * dx + dy * dy)
        angle = 2 * F.atan2(rho, F.lit(2 * radius * self.k0))
        chi = F.asin(F.cos(angle) * math.sin(chi0) + F.when(rho > 0, dy * F.sin(angle) * math.cos(chi0) / rho).otherwise(F.lit(0.0)))
        lam = F.atan2(dx * F.sin(angle), rho * math.cos(chi0) * F.cos(angle) - dy * math.sin(chi0) * F.sin(angle))
        lam = F.when(rho > 0, lam).otherwise(F.lit(0.0))
        e = self.ellipsoid.e
        q = F.log((1 + F.sin(chi)) / (c * (1 - F.sin(chi)))) / (2 * n)  # isometric latitude
        phi = 2 * F.atan(F.exp(q)) - math.pi / 2
        for _ in range(rounds):
            phi = F.asin(F.tanh(q + e * F.atanh(e * F.sin(phi))))
        return F.degrees(phi), self.lon0 + F.degrees(lam) / n


@dataclass(frozen=True)
class LambertAzimuthalEqualArea:
    ellipsoid: Ellipsoid
    lat0: float
    lon0: float
    false_east: float
    false_north: float

    def _q(self, s: float) -> float:
        e, e2 = self.ellipsoid.e, self.ellipsoid.e2
        return (1 - e2) * (s / (1 - e2 * s * s) + math.atanh(e * s) / e)

    def _constants(self) -> tuple[float, float, float, float]:
        s = math.sin(math.radians(self.lat0))
        q_pole = self._q(1.0)
        beta = math.asin(self._q(s) / q_pole)
        rq = self.ellipsoid.a * math.sqrt(q_pole / 2)
        d = self.ellipsoid.a * math.cos(math.radians(self.lat0)) / math.sqrt(1 - self.ellipsoid.e2 * s * s) / (rq * math.cos(beta))
        return q_pole, beta, rq, d

    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        q_pole, beta0, rq, d = self._constants()
        e, e2 = self.ellipsoid.e, self.ellipsoid.e2
        s, lam = F.sin(F.radians(lat)), F.radians(lon - self.lon0)
        q = (1 - e2) * (s / (1 - e2 * s * s) + F.atanh(e * s) / e)
        beta = F.asin(q / q_pole)
        b = rq * F.sqrt(2 / (1 + math.sin(beta0) * F.sin(beta) + math.cos(beta0) * F.cos(beta) * F.cos(lam)))
        return self.false_east + b * d * F.cos(beta) * F.sin(lam), self.false_north + b / d * (math.cos(beta0) * F.sin(beta) - math.sin(beta0) * F.cos(beta) * F.cos(lam))

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        _, beta0, rq, d = self._constants()
        dx, dy = (x - self.false_east) / d, (y - self.false_north) * d
        rho = F.sqrt(dx * dx + dy * dy)
        c = 2 * F.asin(rho / (2 * rq))
        beta = F.asin(F.cos(c) * math.sin(beta0) + F.when(rho > 0, dy * F.sin(c) * math.cos(beta0) / rho).otherwise(F.lit(0.0)))
        lam = F.when(rho > 0, F.atan2(dx * F.sin(c), rho * math.cos(beta0) * F.cos(c) - dy * math.sin(beta0) * F.sin(c))).otherwise(F.lit(0.0))
        q = self.ellipsoid.e2
        phi = beta + (q / 3 + 31 * q**2 / 180 + 517 * q**3 / 5040) * F.sin(2 * beta) + (23 * q**2 / 360 + 251 * q**3 / 3780) * F.sin(4 * beta) + 761 * q**3 / 45360 * F.sin(6 * beta)
        return F.degrees(phi), self.lon0 + F.degrees(lam)


# Published projection parameters.
RD_NEW = ObliqueStereographic(BESSEL, 52.15616055555555, 5.38763888888889, 0.9999079, 155_000.0, 463_000.0)
ETRS89_LAEA = LambertAzimuthalEqualArea(GRS80, 52.0, 10.0, 4_321_000.0, 3_210_000.0)

#: Systems on another datum: ellipsoid, shift to WGS 84, projection.
SHIFTED = {28992: (BESSEL, RD_TO_WGS84, RD_NEW), 23031: (INTERNATIONAL, ED50_TO_WGS84, TransverseMercator.utm(31, ellipsoid=INTERNATIONAL))}


def lonlat_to_px(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Web Mercator pixels at 256 a tile."""
    size = 256.0 * 2**zoom
    s = F.sin(F.radians(lat))
    return (lon + 180) / 360 * size, (0.5 - F.atanh(s) / (2 * math.pi)) * size


def px_to_lonlat(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    size = 256.0 * 2**zoom
    return x / size * 360 - 180, F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / size))))


def mercator_scale(lat: Column, zoom: int) -> Column:
    """Metres a pixel."""
    return 2 * math.pi * MERCATOR_RADIUS / (256.0 * 2**zoom) * F.cos(F.radians(lat))


def wrap180(angle: Column) -> Column:
    return F.pmod(angle + 180, F.lit(360)) - 180


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * EARTH_RADIUS * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def initial_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d = F.radians(lon2 - lon1)
    p, q = F.radians(lat1), F.radians(lat2)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))), F.lit(360.0))


def local_scale(lat: Column) -> tuple[Column, Column]:
    """Metres in a degree of latitude and of longitude, on WGS 84."""
    phi = F.radians(lat)
    w = 1 - WGS84.e2 * F.sin(phi) * F.sin(phi)
    per = math.pi / 180 * WGS84.a
    return per * (1 - WGS84.e2) / (w * F.sqrt(w)), per * F.cos(phi) / F.sqrt(w)


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on the tangent plane at the mean latitude."""
    north, east = local_scale((lat1 + lat2) / 2)
    return F.hypot((lat2 - lat1) * north, (lon2 - lon1) * east)


def offset_m(lat: Column, lon: Column, bearing: Column, metres: Column) -> tuple[Column, Column]:
    """The place at a bearing and distance on the tangent plane."""
    north, east = local_scale(lat)
    return lat + metres * F.cos(F.radians(bearing)) / north, lon + metres * F.sin(F.radians(bearing)) / east


def utm_zone(lon: Column) -> Column:
    return F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(1)), F.lit(60)).cast("int")


def utm_epsg(lat: Column, lon: Column) -> Column:
    return F.when(lat < 0, 32700).otherwise(32600) + utm_zone(lon)


def with_projected(df: DataFrame, epsg: int, lat: str, lon: str, x: str, y: str) -> DataFrame:
    """``df`` with x and y of its positions; a datum shift is a projection of its own, so that its terms are worked out once."""
    shift = SHIFTED.get(epsg)
    if shift is None:
        a, b = from_wgs84(epsg, F.col(lat), F.col(lon))
        return df.withColumns({x: a, y: b})
    ellipsoid, to_wgs, projection = shift
    columns = df.columns
    for names, values in (
        (("_gx", "_gy", "_gz"), lambda: to_wgs.inverse().apply(*to_geocentric(F.col(lat), F.col(lon), WGS84))),
        (("_lat", "_lon"), lambda: from_geocentric(F.col("_gx"), F.col("_gy"), F.col("_gz"), ellipsoid)),
        ((x, y), lambda: projection.forward(F.col("_lat"), F.col("_lon"))),
    ):
        df = df.withColumns(dict(zip(names, values(), strict=True)))
    return df.select(*columns, x, y)


def from_wgs84(epsg: int, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing (or longitude and latitude for 4326)."""
    if epsg == 4326:
        return lon, lat
    if epsg == 3857:
        return F.radians(lon) * MERCATOR_RADIUS, F.atanh(F.sin(F.radians(lat))) * MERCATOR_RADIUS
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        return TransverseMercator.utm(epsg % 100, epsg > 32700).forward(lat, lon)
    if 25828 <= epsg <= 25838:
        return TransverseMercator.utm(epsg - 25800, ellipsoid=GRS80).forward(lat, lon)
    if epsg == 28992:
        return RD_NEW.forward(*datum_shift(lat, lon, WGS84, RD_TO_WGS84.inverse(), BESSEL))
    if epsg == 3035:
        return ETRS89_LAEA.forward(lat, lon)
    if epsg == 23031:
        return TransverseMercator.utm(31, ellipsoid=INTERNATIONAL).forward(*datum_shift(lat, lon, WGS84, ED50_TO_WGS84.inverse(), INTERNATIONAL))
    raise ValueError(f"unknown coordinate system {epsg}")


def to_wgs84(epsg: int, x: Column, y: Column) -> tuple[Column, Column]:
    """Latitude and longitude."""
    if epsg == 4326:
        return y, x
    if epsg == 3857:
        return F.degrees(F.atan(F.sinh(y / MERCATOR_RADIUS))), F.degrees(x / MERCATOR_RADIUS)
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        return TransverseMercator.utm(epsg % 100, epsg > 32700).inverse(x, y)
    if 25828 <= epsg <= 25838:
        return TransverseMercator.utm(epsg - 25800, ellipsoid=GRS80).inverse(x, y)
    if epsg == 28992:
        return datum_shift(*RD_NEW.inverse(x, y), BESSEL, RD_TO_WGS84, WGS84)
    if epsg == 3035:
        return ETRS89_LAEA.inverse(x, y)
    if epsg == 23031:
        return datum_shift(*TransverseMercator.utm(31, ellipsoid=INTERNATIONAL).inverse(x, y), INTERNATIONAL, ED50_TO_WGS84, WGS84)
    raise ValueError(f"unknown coordinate system {epsg}")


def tiles_for(west: Column, south: Column, east: Column, north: Column, zoom: int) -> Column:
    """The tiles (x, y) that cover a box, as an array of structs."""
    x0, y0 = lonlat_to_px(west, north, zoom)
    x1, y1 = lonlat_to_px(east, south, zoom)
    most = 2**zoom - 1
    tile = lambda v: F.least(F.greatest(F.floor(v / 256), F.lit(0)), F.lit(most))
    xs, ys = F.sequence(tile(x0), tile(x1)), F.sequence(tile(y0), tile(y1))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def to_dms(value: Column, positive: str, negative: str) -> Column:
    """Degrees, minutes and seconds with a hemisphere letter; seconds carry into minutes."""
    total = F.round(F.abs(value) * 36000).cast("long")  # tenths of a second
    return F.format_string("%d°%02d'%04.1f\"%s", F.floor(total / 36000), F.floor(total / 600) % 60, (total % 600) / 10, F.when(value < 0, negative).otherwise(positive))


def to_dm(value: Column, positive: str, negative: str) -> Column:
    total = F.round(F.abs(value) * 60000).cast("long")  # thousandths of a minute
    return F.format_string("%d°%06.3f'%s", F.floor(total / 60000), (total % 60000) / 1000, F.when(value < 0, negative).otherwise(positive))


def suggested_systems(lat: Column, lon: Column) -> Column:
    """EPSG codes to offer at a place: WGS 84, the UTM zone, and the regional grids that hold it."""
    dutch = lat.between(50.0, 54.0) & lon.between(3.0, 8.0)
    european = lat.between(34.0, 72.0) & lon.between(-25.0, 45.0)
    none = F.array().cast("array<int>")
    return F.concat(F.array(F.lit(4326), utm_epsg(lat, lon).cast("int")), F.when(dutch, F.array(F.lit(28992))).otherwise(none), F.when(european, F.array(F.lit(3035), F.lit(23031))).otherwise(none))


def formatted(epsg: int, lat: Column, lon: Column) -> tuple[Column, Column]:
    """A place in a system as a report prints it: eight places for degrees, two for metres."""
    x, y = from_wgs84(epsg, lat, lon)
    shape = "%.8f" if epsg == 4326 else "%.2f"
    return F.format_string(shape, x), F.format_string(shape, y)
