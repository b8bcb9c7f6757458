"""Acoustics and display scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres a second that recorders assume when they convert times to metres.
C_RECORDED = 1500.0


def slant_range_m(nsamples: Column, interval_ns: Column, c: float = C_RECORDED) -> Column:
    return nsamples * interval_ns * 1e-9 * c / 2


def resolution_m(interval_ns: Column, c: float = C_RECORDED) -> Column:
    return interval_ns * 1e-9 * c / 2


def altitude_valid(validity: Column, altitude: Column) -> Column:
    """Bit 6 says that the altitude was measured; zero means unfilled."""
    return (validity.bitwiseAND(64) != 0) & (altitude > 0)


def has_position(lat: Column, lon: Column) -> Column:
    return lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & ~((lat == 0) & (lon == 0))


def coord_to_degrees(raw: Column, units: Column) -> Column:
    """Recorded coordinates: ten-thousandths of a minute (2) or micro-degrees (3)."""
    return F.when(units == 2, raw / 1e4 / 60).when(units == 3, raw / 1e6)


def to_ground(across: Column, altitude: Column) -> Column:
    return F.signum(across) * F.sqrt(F.greatest(across * across - altitude * altitude, F.lit(0.0)))


def from_ground(across: Column, altitude: Column) -> Column:
    return F.signum(across) * F.sqrt(across * across + altitude * altitude)


def range_bucket(slant: Column) -> Column:
    """Half-metre steps of slant range."""
    return F.round(slant / 0.5).cast("long")


def absorption_db_per_km(khz: Column, celsius: float, psu: float, metres: float) -> Column:
    """Francois and Garrison (1982) at pH 8. The published coefficients."""
    import math

    t, s, d = celsius, psu, metres
    c = 1412 + 3.21 * t + 1.19 * s + 0.0167 * d
    kelvin = 273 + t
    f1 = 2.8 * math.sqrt(s / 35) * 10 ** (4 - 1245 / kelvin)
    a1 = 8.86 / c * 10 ** (0.78 * 8 - 5)
    f2 = 8.17 * 10 ** (8 - 1990 / kelvin) / (1 + 0.0018 * (s - 35))
    a2 = 21.44 * s / c * (1 + 0.025 * t)
    p2 = 1 - 1.37e-4 * d + 6.2e-9 * d * d
    if t <= 20:
        a3 = 4.937e-4 - 2.59e-5 * t + 9.11e-7 * t**2 - 1.50e-8 * t**3
    else:
        a3 = 3.964e-4 - 1.146e-5 * t + 1.45e-7 * t**2 - 6.5e-10 * t**3
    p3 = 1 - 3.83e-5 * d + 4.9e-10 * d * d
    ff = khz * khz
    return a1 * f1 * ff / (f1 * f1 + ff) + a2 * p2 * f2 * ff / (f2 * f2 + ff) + a3 * p3 * ff


def mackenzie(celsius: float, psu: float, metres: float) -> float:
    """Speed of sound. The published coefficients."""
    t, s, d = celsius, psu - 35, metres
    return 1448.96 + 4.591 * t - 5.304e-2 * t * t + 2.374e-4 * t**3 + 1.340 * s + 1.630e-2 * d + 1.675e-7 * d * d - 1.025e-2 * t * s - 7.139e-13 * t * d**3


def temperature_from_sound_speed(c: float, psu: float, metres: float) -> float:
    """The temperature between -2 and 35 degrees at which sound has this speed, by bisection."""
    low, high = -2.0, 35.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mackenzie(middle, psu, metres) < c else (low, middle)
    return (low + high) / 2


def tvg_gain(r: Column, reference: float, alpha: float, strength: float) -> Column:
    """Spreading and absorption made good relative to a reference range; one where it makes no sense."""
    db = 30 * F.log10(r / reference) + 2 * alpha * (r - reference)
    return F.when((r > 0) & F.lit(reference > 0), F.pow(F.lit(10.0), strength * db / 20)).otherwise(F.lit(1.0))


def stretch(value: Column, low: Column, high: Column, gamma: float) -> Column:
    """Grey level 0..255 of a value between two limits."""
    share = F.least(F.greatest((value - low) / F.greatest(high - low, F.lit(1e-9)), F.lit(0.0)), F.lit(1.0))
    return F.round(F.pow(share, F.lit(gamma)) * 255).cast("int")


def decibels(value: Column) -> Column:
    return 20 * F.log10(F.greatest(value, F.lit(1e-6)))


def piecewise(x: Column, points: list[tuple[float, float]]) -> Column:
    """Linear between the points and level beyond them."""
    out = F.lit(float(points[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:]))):
        out = F.when(x < x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x <= points[0][0], F.lit(float(points[0][1]))).otherwise(out)


def shape_priority(p: Column, exponent: float = 8.0, floor: float = 0.04) -> Column:
    return F.pow(F.greatest(p, F.lit(floor)), F.lit(exponent))


def quantise(value: Column, low: Column, high: Column) -> Column:
    """Codes 0..65534 between two limits; 65535 stands for no data."""
    span = F.when(high > low, high - low).otherwise(F.lit(1.0))
    return F.when(value.isNull(), F.lit(65535)).otherwise(F.round((value - low) / span * 65534)).cast("int")


def dequantise(code: Column, low: Column, high: Column) -> Column:
    return F.when(code != 65535, low + code / 65534 * (high - low))
