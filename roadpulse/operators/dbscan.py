"""DBSCAN on (lat, lon) with the haversine metric (J-9, M-17), cluster
profiles (A-17), zone filter (J-7).

Semantics: eps in degrees of arc (0.005 deg ~ 0.556 km), ``min_samples``
counts the point itself, a neighbour is at central angle <= eps.  Clusters
are numbered 0.. by their smallest core-point id; a border point joins the
lowest-numbered adjacent cluster; the rest is noise (-1).

No all-pairs step runs inside a dense group:

* points fall in *cells* of side eps/2 (degrees, both axes); any two points
  of one cell are neighbours (meridian + parallel path <= eps/2 + eps/2), so
  a cell holding >= min_samples points is entirely core and one graph node;
* points of dense cells are summarised in K x K *micro-cells* (count and
  centre).  For a micro-cell of side m the triangle inequality bounds every
  member's distance to a target within ``d(centre) +- radians(m)``, so a
  micro-cell is either certainly inside eps, certainly outside, or
  uncertain; for a sparse point only uncertain micro-cells are expanded, to
  their *distinct coordinates* (with multiplicity), so incidents stacked on one
  spot cost one row; two dense cells are compared as quadtrees from the cell
  down, with bounds between the boxes of their points and tests of their outermost
  points, until the first two points within eps are found or none is left;
* points of sparse cells (< min_samples each) are compared point-to-point
  with the sparse points of the surrounding cells -- at most
  (cells in reach) x (min_samples - 1) candidates per point;
* connected components of the core graph use min-label propagation with
  pointer jumping; each round is checkpointed to the session's checkpoint
  folder to cut lineage (executor-loss safe).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_rad
from .ordering import dense_index
from ..session import checkpoint_dir

EPS_DEG = 0.005
MIN_SAMPLES = 10
MICRO = 4


def _reach(eps_deg: float, side: float, phi_max_deg: float) -> tuple[int, int]:
    """Cells (each axis) a neighbour can be away, for latitudes up to phi_max."""
    eps = math.radians(eps_deg)
    c = math.cos(math.radians(min(phi_max_deg, 89.999)))
    dlon = math.degrees(2 * math.asin(min(1.0, math.sin(eps / 2) / c)))
    return math.ceil(eps_deg / side), math.ceil(dlon / side)


def dbscan(points: DataFrame, id_col: str = "id", lat: str = "latitude", lon: str = "longitude",
           eps_deg: float = EPS_DEG, min_samples: int = MIN_SAMPLES, micro: int = MICRO
           ) -> DataFrame:
    """Label every point: (id, cluster, is_core).  Points need non-null lat/lon."""
    spark = points.sparkSession
    checkpoint_dir(spark)
    eps = math.radians(eps_deg)
    side = eps_deg / 2 * (1 - 1e-9)
    m = side / micro
    r_micro = math.radians(m)  # member-to-centre path bound: m/2 + m/2 degrees

    pts = points.select(F.col(id_col).alias("id"), F.col(lat).alias("lat"),
                        F.col(lon).alias("lon"))
    phi_max = pts.agg(F.max(F.abs("lat"))).first()[0]
    if phi_max is None:
        return spark.createDataFrame([], "id long, cluster int, is_core boolean")
    rl, rc = _reach(eps_deg, side, phi_max + eps_deg)

    pts = pts.withColumns({"mi": F.floor(F.col("lat") / m), "mj": F.floor(F.col("lon") / m)})
    pts = pts.withColumns({"ci": F.floor(F.col("mi") / micro), "cj": F.floor(F.col("mj") / micro)})
    cells = pts.groupBy("ci", "cj").agg(F.count(F.lit(1)).alias("cell_n"),
                                        F.min("id").alias("cell_min_id"))
    pts = (pts.join(cells, ["ci", "cj"])
              .withColumn("dense", F.col("cell_n") >= min_samples)).checkpoint()

    off = F.explode(F.sequence(F.lit(-rl), F.lit(rl)))
    offj = F.explode(F.sequence(F.lit(-rc), F.lit(rc)))

    def around(df, keep):
        """Rows of ``df`` repeated for every cell in reach (keys qi, qj)."""
        return (df.select(*keep, (F.col("ci")).alias("_ci"), F.col("cj").alias("_cj"))
                  .withColumn("_di", off).withColumn("_dj", offj)
                  .select(*keep, (F.col("_ci") + F.col("_di")).alias("qi"),
                          (F.col("_cj") + F.col("_dj")).alias("qj")))

    sparse = pts.filter(~F.col("dense")).select("id", "lat", "lon", "ci", "cj")
    dense_pts = pts.filter(F.col("dense")).select("id", "lat", "lon", "mi", "mj", "ci", "cj")
    micro_cells = (dense_pts.groupBy("ci", "cj", "mi", "mj")
                   .agg(F.count(F.lit(1)).alias("mn"))
                   .withColumns({"mlat": (F.col("mi") + 0.5) * m, "mlon": (F.col("mj") + 0.5) * m}))

    # --- sparse point vs sparse points (point tests, bounded candidates) ----
    sp_a = around(sparse, ["id", "lat", "lon"])
    sp_b = sparse.select(F.col("id").alias("qid"), F.col("lat").alias("qlat"),
                         F.col("lon").alias("qlon"), F.col("ci").alias("qi"),
                         F.col("cj").alias("qj"))
    ss = (sp_a.join(sp_b, ["qi", "qj"])
          .filter(haversine_rad(F.col("lat"), F.col("lon"), F.col("qlat"), F.col("qlon")) <= eps)
          .select("id", "qid")).checkpoint()  # reused by counts, edges and borders

    # --- sparse point vs dense micro-cells -------------------------------
    mc = micro_cells.select(F.col("ci").alias("qi"), F.col("cj").alias("qj"), "mi", "mj",
                            "mn", "mlat", "mlon")
    sm = (sp_a.join(mc, ["qi", "qj"])
          .withColumn("_d", haversine_rad(F.col("lat"), F.col("lon"), F.col("mlat"), F.col("mlon")))
          .filter(F.col("_d") <= eps + r_micro)).checkpoint()
    certain = F.col("_d") <= eps - r_micro
    sm_certain = sm.filter(certain).select("id", "qi", "qj", "mn")
    # point fallback on distinct coordinates with multiplicity: incidents
    # logged at the same spot (a junction) collapse to one row
    dp = (dense_pts.groupBy("mi", "mj", F.col("lat").alias("qlat"), F.col("lon").alias("qlon"))
          .agg(F.count(F.lit(1)).alias("qn")))
    sm_points = (sm.filter(~certain).select("id", "lat", "lon", "qi", "qj", "mi", "mj")
                 .join(dp, ["mi", "mj"])
                 .filter(haversine_rad(F.col("lat"), F.col("lon"), F.col("qlat"),
                                       F.col("qlon")) <= eps)
                 .select("id", "qi", "qj", "qn")).checkpoint()

    counts = (ss.groupBy("id").agg(F.count(F.lit(1)).alias("n1"))
              .join(sm_certain.groupBy("id").agg(F.sum("mn").alias("n2")), "id", "full_outer")
              .join(sm_points.groupBy("id").agg(F.sum("qn").alias("n3")), "id", "full_outer"))
    counts = counts.select("id", (F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))
                                  + F.coalesce("n3", F.lit(0))).alias("nb"))
    sparse_core = counts.filter(F.col("nb") >= min_samples).select("id").checkpoint()

    # --- graph nodes: dense cells (id = smallest member id) + sparse cores --
    cell_node = cells.filter(F.col("cell_n") >= min_samples).select(
        F.col("ci").alias("qi"), F.col("cj").alias("qj"), F.col("cell_min_id").alias("node"))
    core_flag = sparse_core.withColumn("_core", F.lit(True))
    # sparse x sparse edges between cores
    e1 = (ss.join(core_flag, "id").join(core_flag.withColumnRenamed("id", "qid")
                                            .withColumnRenamed("_core", "_qcore"), "qid")
          .select(F.col("id").alias("a"), F.col("qid").alias("b")))
    # sparse core x dense cell (any member within eps)
    sd = (sm_certain.select("id", "qi", "qj").unionByName(sm_points.select("id", "qi", "qj"))
          .join(sparse_core, "id").join(cell_node, ["qi", "qj"])
          .select(F.col("id").alias("a"), F.col("node").alias("b")))
    # dense cell x dense cell: quadtrees from the cells down, each pair of cells once
    dense_cells = cell_node.select(F.col("qi").alias("ci"), F.col("qj").alias("cj"))
    pairs = (around(dense_cells, ["ci", "cj"]).join(cell_node.select("qi", "qj"), ["qi", "qj"])
             .filter((F.col("ci") < F.col("qi")) | ((F.col("ci") == F.col("qi")) & (F.col("cj") < F.col("qj")))))
    coords = dense_pts.select("mi", "mj", "lat", "lon").distinct()  # existence only
    touching = _touching(pairs.select("ci", "cj", "qi", "qj", F.col("ci").alias("ai"), F.col("cj").alias("aj"),
                                      F.col("qi").alias("bi"), F.col("qj").alias("bj")), coords.checkpoint(), m, eps, micro)
    cn_a = cell_node.select(F.col("qi").alias("ci"), F.col("qj").alias("cj"),
                            F.col("node").alias("a"))
    dd = (touching
          .join(cn_a, ["ci", "cj"]).join(cell_node, ["qi", "qj"])
          .select("a", F.col("node").alias("b")))
    edges = e1.unionByName(sd).unionByName(dd)
    edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = edges.filter(F.col("a") != F.col("b")).distinct().checkpoint()

    nodes = (cell_node.select("node").unionByName(sparse_core.select(F.col("id").alias("node")))
             .distinct())
    labels = _components(nodes, edges)

    # --- number clusters by smallest core id ------------------------------
    order = dense_index(labels, "label", "cluster")
    node_cluster = labels.join(order, "label").select("node", "cluster").checkpoint()

    dense_lab = (pts.filter(F.col("dense"))
                 .join(cell_node.select(F.col("qi").alias("ci"), F.col("qj").alias("cj"), "node"),
                       ["ci", "cj"])
                 .join(node_cluster, "node")
                 .select("id", "cluster", F.lit(True).alias("is_core")))
    sparse_core_lab = (sparse_core.withColumnRenamed("id", "node").join(node_cluster, "node")
                       .select(F.col("node").alias("id"), "cluster", F.lit(True).alias("is_core")))
    # border: non-core sparse points adjacent to a core (sparse core or dense cell)
    to_sparse_core = (ss.join(sparse_core.withColumnRenamed("id", "qid"), "qid")
                      .join(node_cluster.withColumnRenamed("node", "qid"), "qid")
                      .select("id", "cluster"))
    to_dense = (sm_certain.select("id", "qi", "qj").unionByName(sm_points.select("id", "qi", "qj"))
                .join(cell_node, ["qi", "qj"]).join(node_cluster, "node")
                .select("id", "cluster"))
    border = (to_sparse_core.unionByName(to_dense)
              .join(sparse_core, "id", "left_anti")
              .groupBy("id").agg(F.min("cluster").alias("cluster"))
              .withColumn("is_core", F.lit(False)))
    labelled = dense_lab.unionByName(sparse_core_lab).unionByName(border)
    # dense points are all labelled; only ids that sparse points share matter here
    shared = dense_pts.select("id").join(sparse.select("id"), "id", "left_semi")
    taken = sparse_core_lab.select("id").unionByName(border.select("id")).unionByName(shared)
    noise = (sparse.select("id").join(taken, "id", "left_anti")
             .select("id", F.lit(-1).alias("cluster"), F.lit(False).alias("is_core")))
    return labelled.unionByName(noise)


def _box_bounds(a: str, b: str):
    """Least and greatest central angle between points of two boxes (columns <x>_south, _north, _west, _east)."""
    c = lambda side, edge: F.radians(f"{side}_{edge}")
    gap = lambda low, high: F.greatest(c(b, low) - c(a, high), c(a, low) - c(b, high), F.lit(0.0))
    reach = lambda low, high: F.greatest(c(b, high) - c(a, low), c(a, high) - c(b, low))
    flat = lambda side: F.cos(F.greatest(F.abs(c(side, "south")), F.abs(c(side, "north"))))
    wide = lambda side: F.cos(F.when(c(side, "south") * c(side, "north") <= 0, F.lit(0.0)).otherwise(
        F.least(F.abs(c(side, "south")), F.abs(c(side, "north")))))

    def angle(dlat, dlon, scale):
        h = F.pow(F.sin(dlat / 2), 2) + scale * F.pow(F.sin(dlon / 2), 2)
        return 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
    return (angle(gap("south", "north"), gap("west", "east"), flat(a) * flat(b)),
            angle(reach("south", "north"), reach("west", "east"), wide(a) * wide(b)))


def _touching(pairs: DataFrame, coords: DataFrame, m: float, eps: float, micro: int | None = None) -> DataFrame:
    """Cell pairs (ci, cj, qi, qj) with two points within eps, among pairs of nodes (ai, aj) and (bi, bj): micro-cells, or cells of ``micro``.

    A quadtree: a pair of nodes is decided by the bounds between the boxes of
    their points, or by two of their outermost points being near; else
    both are split.  A cell pair stops at its first hit, and nodes of one
    coordinate each are decided by it, so points are never paired wholesale.
    """
    sides, found, level = ("ci", "cj", "qi", "qj"), None, 0
    pairs, cells = pairs.checkpoint(), 0 if micro is None else 1
    corners = ("sw", "ne", "nw", "se")

    def at(axis: str, level: int):
        """Number of the node that holds a coordinate: cells, if they are the first level, then micro-cells and their parts."""
        if level < cells:
            return F.floor(F.floor(F.col(axis) / m) / micro)
        return F.floor(F.col(axis) / (m / 2 ** (level - cells)))

    def nodes(side: str, level: int) -> DataFrame:
        sum_, diff, point = F.col("lat") + F.col("lon"), F.col("lat") - F.col("lon"), F.struct("lat", "lon")
        return coords.groupBy(at("lat", level).alias(f"{side}i"), at("lon", level).alias(f"{side}j")).agg(
            F.min("lat").alias(f"{side}_south"), F.max("lat").alias(f"{side}_north"),
            F.min("lon").alias(f"{side}_west"), F.max("lon").alias(f"{side}_east"),
            F.min_by(point, sum_).alias(f"{side}_sw"), F.max_by(point, sum_).alias(f"{side}_ne"),
            F.max_by(point, diff).alias(f"{side}_nw"), F.min_by(point, diff).alias(f"{side}_se"))

    def angle(a: str, b: str):
        return haversine_rad(F.col(f"{a}.lat"), F.col(f"{a}.lon"), F.col(f"{b}.lat"), F.col(f"{b}.lon"))

    while not pairs.isEmpty():
        seen = pairs.join(nodes("a", level), ["ai", "aj"]).join(nodes("b", level), ["bi", "bj"])
        low, high = _box_bounds("a", "b")
        near = F.least(*[angle(f"a_{x}", f"b_{y}") for x in corners for y in corners]) <= eps
        single = ((F.col("a_south") == F.col("a_north")) & (F.col("a_west") == F.col("a_east"))
                  & (F.col("b_south") == F.col("b_north")) & (F.col("b_west") == F.col("b_east")))
        judged = seen.select(*sides, "ai", "aj", "bi", "bj", (near | (high <= eps * (1 - 1e-12))).alias("hit"),
                             (single | (low > eps * (1 + 1e-12))).alias("out")).checkpoint()
        hits = judged.filter("hit").select(*sides).distinct()
        found = hits if found is None else found.unionByName(hits)
        level += 1
        parts = micro if level <= cells and cells else 2
        kids = coords.select(at("lat", level).alias("ki"), at("lon", level).alias("kj")).distinct()
        of = lambda side: kids.select(F.floor(F.col("ki") / parts).alias(f"{side}i"), F.floor(F.col("kj") / parts).alias(f"{side}j"),
                                      F.col("ki").alias(f"{side}ki"), F.col("kj").alias(f"{side}kj"))
        pairs = (judged.filter("not hit and not out").join(hits, list(sides), "left_anti")
                 .join(of("a"), ["ai", "aj"]).join(of("b"), ["bi", "bj"])
                 .select(*sides, F.col("aki").alias("ai"), F.col("akj").alias("aj"), F.col("bki").alias("bi"),
                         F.col("bkj").alias("bj"))).checkpoint()
    return pairs.select(*sides) if found is None else found.distinct()


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Min-label propagation with pointer jumping to the fixpoint; returns (node, label)."""
    lab = nodes.select("node", F.col("node").alias("label")).checkpoint()
    while True:
        nb = (edges.join(lab.withColumnRenamed("node", "b"), "b")
              .groupBy("a").agg(F.min("label").alias("nl")))
        step = (lab.join(nb.withColumnRenamed("a", "node"), "node", "left")
                .select("node", F.least("label", F.coalesce("nl", "label")).alias("label")))
        # pointer jumping: adopt the label of your label
        jump = (step.join(step.select(F.col("node").alias("label"),
                                      F.col("label").alias("l2")), "label", "left")
                .select("node", F.least("label", F.coalesce("l2", "label")).alias("label")))
        new = jump.checkpoint()
        changed = (new.join(lab.withColumnRenamed("label", "old"), "node")
                   .filter(F.col("label") != F.col("old")).limit(1).count())
        lab = new
        if changed == 0:
            return lab


def cluster_points(prepared: DataFrame, labels: DataFrame, id_col: str = "incident_id"
                   ) -> DataFrame:
    """Cluster points with their attributes (zone carried so J-7 works)."""
    return prepared.select(F.col(id_col).alias("id"), "latitude", "longitude", "event_cause",
                           "priority", "zone").join(labels, "id")


def cluster_profiles(points: DataFrame) -> DataFrame:
    """A-17: count of causes, high %, centroid, top cause (smallest on ties)."""
    clustered = points.filter(F.col("cluster") >= 0)
    return clustered.groupBy("cluster").agg(
        F.count("event_cause").alias("event_count"),
        (F.avg(F.col("priority").eqNullSafe("High").cast("int")) * 100).alias("high_priority_pct"),
        F.avg("latitude").alias("centroid_lat"),
        F.avg("longitude").alias("centroid_lon"),
        F.mode("event_cause", True).alias("top_cause"))


def profiles_by_zone(profiles: DataFrame, points: DataFrame) -> DataFrame:
    """J-7 for every zone at once: (zone, profile) for clusters with a point in the zone."""
    hits = points.filter(F.col("cluster") >= 0).select("zone", "cluster").distinct()
    return hits.join(profiles, "cluster")
