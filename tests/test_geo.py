import random

import pytest
from pyspark.sql import functions as F

from roadpulse.functions.geo import GEOHASH_ALPHABET, geohash, haversine_rad, with_geohash


def bisect_geohash(lat, lon, precision):
    """Plain bisection (strict '>' goes up), longitude bit first."""
    la, lo = [-90.0, 90.0], [-180.0, 180.0]
    bits, out, even = [], [], True
    while len(out) < precision:
        rng, v = (lo, lon) if even else (la, lat)
        mid = (rng[0] + rng[1]) / 2
        if v > mid:
            bits.append(1)
            rng[0] = mid
        else:
            bits.append(0)
            rng[1] = mid
        even = not even
        if len(bits) == 5:
            out.append(GEOHASH_ALPHABET[int("".join(map(str, bits)), 2)])
            bits = []
    return "".join(out)


@pytest.mark.parametrize("lat,lon,expected", [
    (12.9716, 77.5946, "tdr1v9"),
    (57.64911, 10.40744, "u4pruy"),
    (0.0, 0.0, "7zzzzz"),
    (-90.0, -180.0, "000000"),
])
def test_vectors(spark, lat, lon, expected):
    df = spark.createDataFrame([(lat, lon)], "lat double, lon double")
    assert df.select(geohash("lat", "lon", 6)).first()[0] == expected
    assert with_geohash(df, "lat", "lon", "g").first()["g"] == expected


def test_null_in_null_out(spark):
    df = spark.createDataFrame([(None, 77.5), (12.9, None)], "lat double, lon double")
    assert [r[0] for r in df.select(geohash("lat", "lon")).collect()] == [None, None]


@pytest.mark.parametrize("precision", [1, 5, 6, 7, 11])
def test_random_points_match_bisection(spark, precision):
    rnd = random.Random(precision)
    pts = [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(300)]
    pts += [(12.75 + i * 0.0001, 77.25 + i * 0.0002) for i in range(200)]
    df = spark.createDataFrame(pts, "lat double, lon double")
    got = [r[0] for r in with_geohash(df, "lat", "lon", "g", precision).select("g").collect()]
    assert got == [bisect_geohash(a, b, precision) for a, b in pts]


def test_haversine(spark):
    import math
    df = spark.createDataFrame([(12.9716, 77.5946, 12.9716, 77.5946),
                                (0.0, 0.0, 0.0, 1.0)], "a double, b double, c double, d double")
    d = [r[0] for r in df.select(haversine_rad(F.col("a"), F.col("b"), F.col("c"),
                                               F.col("d"))).collect()]
    assert d[0] == 0.0
    assert abs(d[1] - math.radians(1.0)) < 1e-12
