"""Spatial column functions: geohash (S-7) and haversine (S-10).

The geohash is a native column expression (no UDF): each coordinate is
quantised to its bisection cell index, the two indices are bit-interleaved
and the resulting integer is written in the geohash base-32 alphabet.
Bisection sends a point lying exactly on a split line to the lower half
(strict ``>`` test), so the index of ``x`` is the number of interior grid
lines strictly below ``x``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The geohash alphabet (base-32 digits in order).
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
_CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"

EARTH_RADIUS_KM = 6371.0088


def _cell_index(x: Column, lo: float, hi: float, bits: int) -> Column:
    """Index of the bisection cell holding ``x`` in [lo, hi] at ``bits`` depth."""
    n = 1 << bits
    step = (hi - lo) / n  # exact: span / 2^bits

    def grid(j: Column) -> Column:
        return F.lit(lo) + j.cast("double") * F.lit(step)

    q0 = F.ceil((x - F.lit(lo)) / F.lit(step)).cast("long") - 1
    # one-step correction against the exact grid so rounding in the division
    # can never move a point across a split line
    q1 = (F.when((q0 + 1 <= n - 1) & (grid(q0 + 1) < x), q0 + 1)
          .when((q0 >= 1) & (grid(q0) >= x), q0 - 1)
          .otherwise(q0))
    return F.least(F.greatest(q1, F.lit(0)), F.lit(n - 1))


def _spread_table() -> list[int]:
    """spread(i): bit b of i moved to bit 2b, for every 8-bit i (built by rule)."""
    return [sum(((i >> b) & 1) << (2 * b) for b in range(8)) for i in range(256)]


_SPREAD8 = _spread_table()


def _spread(v: Column, bits: int) -> Column:
    """Morton spread of a <= 32-bit index via 8-bit table lookups.

    ``v`` is referenced once per 8-bit chunk (2 for a 15-bit index), so the
    expression stays small even when the optimizer inlines ``v``.
    """
    table = F.array(*[F.lit(x).cast("long") for x in _SPREAD8])
    out = None
    for c in range((bits + 7) // 8):
        chunk = F.shiftright(v, 8 * c).bitwiseAND(F.lit(255))
        part = F.shiftleft(F.element_at(table, (chunk + 1).cast("int")), 16 * c)
        out = part if out is None else out.bitwiseOR(part)
    return out


def _interleave(lon_i: Column, lat_i: Column, lon_bits: int, lat_bits: int) -> Column:
    """Bit-interleave the two indices, longitude taking the top bit."""
    lon_s, lat_s = _spread(lon_i, lon_bits), _spread(lat_i, lat_bits)
    if (lon_bits + lat_bits) % 2 == 0:
        return F.shiftleft(lon_s, 1).bitwiseOR(lat_s)
    return lon_s.bitwiseOR(F.shiftleft(lat_s, 1))


def _encode(code: Column, precision: int) -> Column:
    b32 = F.lpad(F.conv(code.cast("string"), 10, 32), precision, "0")
    return F.translate(b32, _CONV_DIGITS, GEOHASH_ALPHABET)


def _bits(precision: int) -> tuple[int, int]:
    if not 1 <= precision <= 12:
        raise ValueError("precision must be within 1..12")
    total = 5 * precision
    return (total + 1) // 2, total // 2


def geohash(lat: Column | str, lon: Column | str, precision: int = 6) -> Column:
    """Geohash string of (lat, lon) as one column expression; null when either is null.

    Prefer ``with_geohash`` on wide tables: it materialises the two cell
    indices in their own projection so the interleave stays small.
    """
    lat = F.col(lat) if isinstance(lat, str) else lat
    lon = F.col(lon) if isinstance(lon, str) else lon
    lon_bits, lat_bits = _bits(precision)
    code = _interleave(_cell_index(lon, -180.0, 180.0, lon_bits),
                       _cell_index(lat, -90.0, 90.0, lat_bits), lon_bits, lat_bits)
    return F.when(lat.isNotNull() & lon.isNotNull(), _encode(code, precision))


def with_geohash(df, lat: str = "latitude", lon: str = "longitude", out: str = "geohash6",
                 precision: int = 6):
    """Add the geohash column in two projections (indices, then encoding)."""
    lon_bits, lat_bits = _bits(precision)
    li, ai = f"__{out}_lon_i", f"__{out}_lat_i"
    df = df.withColumns({li: _cell_index(F.col(lon), -180.0, 180.0, lon_bits),
                         ai: _cell_index(F.col(lat), -90.0, 90.0, lat_bits)})
    code = _interleave(F.col(li), F.col(ai), lon_bits, lat_bits)
    enc = F.when(F.col(li).isNotNull() & F.col(ai).isNotNull(), _encode(code, precision))
    return df.withColumn(out, enc).drop(li, ai)


def haversine_rad(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle central angle in radians (haversine formula)."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dlat = p2 - p1
    dlon = F.radians(lon2) - F.radians(lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2.0) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def eps_degrees_to_radians(eps_deg: float) -> float:
    return math.radians(eps_deg)
