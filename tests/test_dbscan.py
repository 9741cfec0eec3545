"""DBSCAN against brute force, and the fixed counts of the incident fixture."""
import math
import random
from collections import deque

import numpy as np
from pyspark.sql import functions as F

from paths import SF0001
from roadpulse.operators.clean import in_box
from roadpulse.operators.dbscan import cluster_profiles, dbscan
from roadpulse.sources.fixture import incident_fixture


def brute(points, eps_deg=0.005, min_samples=10):
    ids = [p[0] for p in points]
    lat = np.radians([p[1] for p in points])
    lon = np.radians([p[2] for p in points])
    a = (np.sin((lat[:, None] - lat[None, :]) / 2) ** 2
         + np.cos(lat[:, None]) * np.cos(lat[None, :]) * np.sin((lon[:, None] - lon[None, :]) / 2) ** 2)
    d = 2 * np.arcsin(np.sqrt(np.minimum(a, 1.0)))
    nb = d <= math.radians(eps_deg)
    core = nb.sum(1) >= min_samples
    labels = [-1] * len(ids)
    cid = 0
    for i in np.argsort(ids):
        if not core[i] or labels[i] != -1:
            continue
        labels[i] = cid
        q = deque([i])
        while q:
            u = q.popleft()
            for v in np.nonzero(nb[u])[0]:
                if labels[v] == -1:
                    labels[v] = cid
                    if core[v]:
                        q.append(v)
        cid += 1
    return {ids[i]: (labels[i], bool(core[i])) for i in range(len(ids))}


def test_matches_brute_force(spark):
    rnd = random.Random(3)
    pts = []
    # very dense hotspot (dense cells, micro-cells certain and uncertain)
    for _ in range(400):
        pts.append((12.97 + rnd.gauss(0, 0.0015), 77.59 + rnd.gauss(0, 0.0015)))
    # a thin chain (sparse cells joining)
    for i in range(60):
        pts.append((12.90 + i * 0.0009, 77.50 + (i % 3) * 0.0004))
    # scattered noise, some next to the hotspot
    for _ in range(250):
        pts.append((12.85 + rnd.random() * 0.2, 77.45 + rnd.random() * 0.2))
    rows = [(i * 7 + 3, a, b) for i, (a, b) in enumerate(pts)]
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double")
    got = {r["id"]: (r["cluster"], r["is_core"]) for r in dbscan(df).collect()}
    assert got == brute(rows)


def test_fixture_counts_sf0001(spark):
    raw = incident_fixture(spark, SF0001)
    pts = raw.filter(in_box(F.col("latitude"), F.col("longitude"))).select(
        F.col("incident_id").alias("id"), "latitude", "longitude")
    lab = dbscan(pts)
    r = lab.agg(F.count(F.lit(1)), F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))),
                F.count_if("is_core"), F.count_if(F.col("cluster") == -1)).first()
    assert tuple(r) == (978, 15, 883, 95)


def test_profiles(spark):
    df = spark.createDataFrame(
        [(0, 1.0, 2.0, "b", "High"), (0, 3.0, 4.0, "a", "Low"), (0, 5.0, 6.0, "b", None),
         (0, 0.0, 0.0, "a", "High"), (-1, 9.0, 9.0, "z", "High")],
        "cluster int, latitude double, longitude double, event_cause string, priority string")
    p = cluster_profiles(df).first()
    assert p["event_count"] == 4 and p["high_priority_pct"] == 50.0
    assert p["top_cause"] == "a" and p["centroid_lat"] == 2.25


def test_stacked_coordinates_hotspot(spark):
    """A third of the rows at one junction, plus points near eps from it."""
    rnd = random.Random(11)
    pts = [(12.95, 77.60)] * 1500 + [(12.95 + 0.0049, 77.60)] * 40
    for _ in range(1500):
        pts.append((12.95 + rnd.uniform(-0.012, 0.012), 77.60 + rnd.uniform(-0.012, 0.012)))
    rows = [(i, a, b) for i, (a, b) in enumerate(pts)]
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double")
    got = {r["id"]: (r["cluster"], r["is_core"]) for r in dbscan(df).collect()}
    assert got == brute(rows)


def test_dense_blobs_about_eps_apart(spark):
    """Blobs of distinct coordinates whose nearest points are just within eps, or just beyond it."""
    rnd = random.Random(5)
    for gap, joined in ((0.005 * 0.9995, True), (0.005 * 1.0005, False)):
        left = [(12.9 - rnd.random() * 0.004, 77.5 + rnd.random() * 0.004) for _ in range(700)] + [(12.9, 77.502)]
        right = [(12.9 + gap + rnd.random() * 0.004, 77.5 + rnd.random() * 0.004) for _ in range(700)] + [(12.9 + gap, 77.502)]
        rows = [(i, a, b) for i, (a, b) in enumerate(left + right)]
        df = spark.createDataFrame(rows, "id long, latitude double, longitude double")
        got = {r["id"]: (r["cluster"], r["is_core"]) for r in dbscan(df).collect()}
        assert got == brute(rows) and len({c for c, _ in got.values()}) == (1 if joined else 2)


def test_quadtree_rows_stay_linear(spark):
    """Judged node pairs for two facing blobs grow no faster than their points."""
    from roadpulse.operators import dbscan as module

    def judged(n):
        rnd = random.Random(n)
        m = 0.005 / 8
        pts = [(12.9 - rnd.random() * m, 77.5 + rnd.random() * m) for _ in range(n)] + \
              [(12.9 + 0.0050001 + rnd.random() * m, 77.5 + rnd.random() * m) for _ in range(n)]
        coords = spark.createDataFrame(pts, "lat double, lon double")
        cells = coords.select(F.floor(F.col("lat") / m).alias("i"), F.floor(F.col("lon") / m).alias("j")).distinct()
        pairs = cells.select(F.lit(0).alias("ci"), F.lit(0).alias("cj"), F.lit(1).alias("qi"), F.lit(1).alias("qj"),
                             F.col("i").alias("ai"), F.col("j").alias("aj")).crossJoin(
            cells.select(F.col("i").alias("bi"), F.col("j").alias("bj"))).where("bi > ai + 3")
        total, plain = [], type(coords).checkpoint

        def counted(self, *a, **k):
            out = plain(self, *a, **k)
            total.append(out.count())
            return out
        type(coords).checkpoint = counted
        try:
            assert module._touching(pairs, coords, m, math.radians(0.005)).count() == 0
        finally:
            type(coords).checkpoint = plain
        return sum(total)
    assert judged(2000) < 2.5 * 2000
