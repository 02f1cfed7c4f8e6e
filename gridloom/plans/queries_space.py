"""Queries over grids, layers and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import geometry as S
from gridloom.operators import graph as H
from gridloom.operators.joins import r6
from gridloom.plans.adapters import ADAPTERS, Tables
from gridloom.plans.catalog import query

SIZE = 5
ADAPTERS["cells"] = """
    SELECT ix, iy, concat('R', CAST(row_number() OVER (ORDER BY iy, ix) - 1 AS STRING)) AS region, -145e0 + 5 * ix AS x0, 40e0 + 5 * iy AS y0, -140e0 + 5 * ix AS x1, 45e0 + 5 * iy AS y1, -142.5e0 + 5 * ix AS cx, 42.5e0 + 5 * iy AS cy, jurisdiction
    FROM (SELECT CAST(floor((lon + 145) / 5) AS INT) AS ix, CAST(floor((lat - 40) / 5) AS INT) AS iy, min(jurisdiction) AS jurisdiction FROM {points} GROUP BY 1, 2)"""
ADAPTERS["zones"] = "SELECT concat('Z', CAST(n_nationkey AS STRING)) AS code, -145e0 + (n_nationkey % 5) * 18 AS xmin, 41e0 + floor(n_nationkey / 5) * 8 AS ymin, -127e0 + (n_nationkey % 5) * 18 - n_nationkey % 3 AS xmax, 49e0 + floor(n_nationkey / 5) * 8 AS ymax, n_nationkey % 5 AS grp FROM {nation}"
ADAPTERS["features"] = "SELECT p_partkey AS feature_id, p_brand AS class, p_type AS layer, -145e0 + (p_partkey * 7) % 88 AS xmin, 42e0 + (p_partkey * 11) % 40 AS ymin, -145e0 + (p_partkey * 7) % 88 + p_size / 1e1 AS xmax, 42e0 + (p_partkey * 11) % 40 + p_size / 2e1 AS ymax, p_retailprice AS value FROM {part}"
ADAPTERS["segments"] = """
    SELECT o_orderkey AS segment_id, o_orderpriority AS class, c_nationkey AS jurisdiction, -141 + ((c_custkey * 37) % 8800) / 1e2 AS x0, 42 + ((c_custkey * 53) % 4000) / 1e2 AS y0,
      -141 + ((c_custkey * 37) % 8800) / 1e2 + (o_orderkey % 13 - 6) AS x1, 42 + ((c_custkey * 53) % 4000) / 1e2 + (o_orderkey % 7 - 3) AS y1 FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""
ADAPTERS["neighbours"] = """
    SELECT a.region, d.direction, coalesce(b.region, 'R-999') AS neighbour FROM (SELECT * FROM {cells}) a CROSS JOIN (SELECT 'up' AS direction, 0 AS dx, 1 AS dy UNION ALL SELECT 'down', 0, -1 UNION ALL SELECT 'left', -1, 0 UNION ALL SELECT 'right', 1, 0) d
    LEFT JOIN (SELECT * FROM {cells}) b ON b.ix = a.ix + d.dx AND b.iy = a.iy + d.dy"""
ADAPTERS["edges"] = """
    SELECT concat(n.region, '-', n.neighbour) AS edge_region, n.region AS region_from, n.neighbour AS region_to, direction, a.cx AS x0, a.cy AS y0, b.cx AS x1, b.cy AS y1, sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) * 100 AS distance_km
    FROM (SELECT * FROM {neighbours} WHERE neighbour <> 'R-999') n JOIN (SELECT * FROM {cells}) a ON a.region = n.region JOIN (SELECT * FROM {cells}) b ON b.region = n.neighbour"""


@query("geo1_bounds", "SELECT floor(min(lon) / 5) * 5 AS xmin, floor(min(lat) / 5) * 5 AS ymin, ceil(max(lon) / 5) * 5 AS xmax, ceil(max(lat) / 5) * 5 AS ymax FROM {points}")
def _(t: Tables) -> DataFrame:
    return S.aligned_bounds(t("points"), "lon", "lat", SIZE)


@query(
    "geo2_candidate_grid",
    """WITH b AS (SELECT floor(min(lon) / 5) * 5 AS xmin, floor(min(lat) / 5) * 5 AS ymin, ceil(max(lon) / 5) * 5 AS xmax, ceil(max(lat) / 5) * 5 AS ymax FROM {points})
    SELECT CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, xmin + 5 * ix AS x0, ymin + 5 * iy AS y0, xmin + 5 * ix + 5 AS x1, ymin + 5 * iy + 5 AS y1, xmin + 5 * ix + 2.5e0 AS cx, ymin + 5 * iy + 2.5e0 AS cy FROM (SELECT *, unnest(range(CAST((ymax - ymin) / 5 AS INT))) AS iy FROM (SELECT *, unnest(range(CAST((xmax - xmin) / 5 AS INT))) AS ix FROM b))""",
)
def _(t: Tables) -> DataFrame:
    return S.candidate_grid(S.aligned_bounds(t("points"), "lon", "lat", SIZE), SIZE)


@query("geo3_retained", "SELECT DISTINCT region FROM {cells}, {zones} WHERE cx > xmin AND cx < xmax AND cy > ymin AND cy < ymax")
def _(t: Tables) -> DataFrame:
    return S.points_in_rectangles(t("cells"), t("zones"), 20.0, "cx", "cy", "region", "code", border="exclude").select("region")


@query("geo4_dense_regions", "SELECT region, ix, iy FROM {cells}")
def _(t: Tables) -> DataFrame:
    return S.dense_regions(t("cells").drop("region")).select("region", "ix", "iy")


@query("geo5_grid_summary", "SELECT jurisdiction, count(*) AS n, min(x0) AS xmin, min(y0) AS ymin, max(x1) AS xmax, max(y1) AS ymax FROM {cells} GROUP BY jurisdiction")
def _(t: Tables) -> DataFrame:
    return S.grid_summary(t("cells"), "jurisdiction")


@query(
    "geo7_projection",
    f"""SELECT point_id, round(6200000 + rho * sin(th), 3) AS x, round(3000000 + {S.RHO_0!r} - rho * cos(th), 3) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM (SELECT *, {S.A * S.FF!r} * pow(t, {S.N!r}) AS rho, {S.N!r} * radians(lon - {S.LON_0!r}) AS th
    FROM (SELECT *, tan(pi() / 4 - radians(lat) / 2) / pow((1 - {S._E!r} * sin(radians(lat))) / (1 + {S._E!r} * sin(radians(lat))), {S._E / 2!r}) AS t FROM {{points}}))""",
)
def _(t: Tables) -> DataFrame:
    x, y = S.project(F.col("lon"), F.col("lat"))
    p = t("points").select("point_id", x.alias("x"), y.alias("y"))
    lon, lat = S.unproject(F.col("x"), F.col("y"))
    return p.select("point_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query(
    "geo8_haversine",
    "SELECT a.point_id AS a, b.n_nationkey AS b, round(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(42 + b.n_nationkey - lat) / 2), 2) + cos(radians(lat)) * cos(radians(42 + b.n_nationkey)) * pow(sin(radians(-100 + b.n_regionkey - lon) / 2), 2)))), 6) AS km FROM {points} a JOIN {nation} b ON b.n_nationkey = a.jurisdiction".replace(
        "{points} a", "(SELECT * FROM {points}) a"
    ).replace("{nation} b", "(SELECT * FROM {nation}) b"),
)
def _(t: Tables) -> DataFrame:
    both = t("points").join(F.broadcast(t("nation")), F.col("n_nationkey") == F.col("jurisdiction"))
    return both.select(F.col("point_id").alias("a"), F.col("n_nationkey").alias("b"), F.round(S.haversine_km(F.col("lon"), F.col("lat"), -100 + F.col("n_regionkey"), 42 + F.col("n_nationkey")), 6).alias("km"))


@query("geo8_geodesic")
def _(t: Tables) -> DataFrame:
    p = t("points")
    return p.select("point_id", F.round(S.geodesic_km("lon", "lat", F.lit(-100.0), F.lit(60.0)), 6).alias("km"))


@query("geo12_evidence", "SELECT class, CASE WHEN layer <> 'PROMO' THEN layer END AS layer, count(*) AS n, round(sum(value), 4) AS source, round(sum((xmax - xmin) * (ymax - ymin)), 4) AS clipped FROM {features} GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    f = t("features").withColumn("area", (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))).withColumn("layer", F.when(F.col("layer") != "PROMO", F.col("layer")))
    return S.evidence_summary(f, ["class", "layer"], "value", "area").select("class", "layer", "n", F.round("source", 4).alias("source"), F.round("clipped", 4).alias("clipped"))


_P = "SELECT point_id, lon AS x, lat AS y, jurisdiction % 5 AS grp, value FROM {points}"


@query("geoj1_point_in_polygon", f"SELECT point_id, min(code) AS code FROM ({_P}) p, {{zones}} WHERE x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax GROUP BY point_id")
def _(t: Tables) -> DataFrame:
    return S.points_in_rectangles(t.sql(_P), t("zones"), 20.0).select("point_id", "code")


_NEAR = f"""WITH d AS (SELECT point_id, code, NOT (x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax) AS o, sqrt(pow(greatest(xmin - x, 0, x - xmax), 2) + pow(greatest(ymin - y, 0, y - ymax), 2)) AS d FROM ({_P}) p, {{zones}} WHERE SAME),
  r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY o, d, code) AS n FROM d WHERE d <= LIMIT_)
  SELECT p.point_id, code, round(d, 6) AS distance, CASE WHEN code IS NULL THEN 'none' WHEN o THEN 'nearest' ELSE 'within' END AS matched_by FROM ({_P}) p LEFT JOIN (SELECT * FROM r WHERE n = 1) USING (point_id)"""


@query("geoj2_within_or_nearest", _NEAR.replace("SAME", "true").replace("LIMIT_", "1.5"))
def _(t: Tables) -> DataFrame:
    return S.within_or_nearest(t.sql(_P), t("zones"), 1.5).select("point_id", "code", *r6("distance"), "matched_by")


@query("geoj5_same_jurisdiction", _NEAR.replace("SAME", "p.grp = zones.grp").replace("LIMIT_", "30"))
def _(t: Tables) -> DataFrame:
    return S.within_or_nearest(t.sql(_P), t("zones"), 30.0, same="grp").select("point_id", "code", *r6("distance"), "matched_by")


@query("geoj3_snap_limit", "SELECT p_partkey, round(1.5e0 * p_size * CASE WHEN p_size % 2 = 0 THEN 111000 ELSE 1000 END, 6) AS metres FROM {part}")
def _(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", F.round(S.snap_limit(1.5, F.col("p_size"), F.when(F.col("p_size") % 2 == 0, "degrees").otherwise("km")), 6).alias("metres"))


@query(
    "geoj4_nearest_hub",
    f"""SELECT point_id, hub, round(d, 6) AS distance FROM (SELECT p.point_id, h.point_id AS hub, sqrt(pow(p.x - h.x, 2) + pow(p.y - h.y, 2)) AS d, row_number() OVER (PARTITION BY p.point_id ORDER BY sqrt(pow(p.x - h.x, 2) + pow(p.y - h.y, 2)), h.point_id) AS n
    FROM ({_P}) p JOIN (SELECT * FROM ({_P}) WHERE point_id LIKE 's%' AND value > 5000) h ON h.grp = p.grp WHERE p.point_id LIKE 'c%') WHERE n = 1""",
)
def _(t: Tables) -> DataFrame:
    p = t.sql(_P)
    return S.nearest_in_group(p.where("point_id like 'c%'"), p.where("point_id like 's%' and value > 5000").withColumnRenamed("point_id", "hub"), "grp", "point_id", "hub").select("point_id", "hub", *r6("distance"))


@query(
    "geoj6_overlay",
    """SELECT code, feature_id, round(a, 6) AS area, round(least(1, a / ((z.xmax - z.xmin) * (z.ymax - z.ymin))), 9) AS left_share, round(least(1, a / ((f.xmax - f.xmin) * (f.ymax - f.ymin))), 6) AS right_share
    FROM (SELECT *, greatest(least(z.xmax, f.xmax) - greatest(z.xmin, f.xmin), 0) * greatest(least(z.ymax, f.ymax) - greatest(z.ymin, f.ymin), 0) AS a FROM (SELECT * FROM {zones}) z, (SELECT * FROM {features}) f) z WHERE a > 0""".replace(
        "FROM (SELECT *, greatest(least(z.xmax", "FROM (SELECT z.code, f.feature_id, z.xmin AS zx, z.ymin AS zy, z.xmax AS zX1, z.ymax AS zY1, f.xmin AS fx, f.ymin AS fy, f.xmax AS fX1, f.ymax AS fY1, greatest(least(z.xmax"
    )
    .replace("((z.xmax - z.xmin) * (z.ymax - z.ymin))", "((zX1 - zx) * (zY1 - zy))")
    .replace("((f.xmax - f.xmin) * (f.ymax - f.ymin))", "((fX1 - fx) * (fY1 - fy))"),
)
def _(t: Tables) -> DataFrame:
    return S.overlay(t("zones"), t("features"), 20.0, "code", "feature_id").select("code", "feature_id", F.round("area", 6).alias("area"), F.round("left_share", 9).alias("left_share"), F.round("right_share", 6).alias("right_share"))


_LAYERS = "SELECT layer, 0.5e0 AS factor, false AS constant, xmin, ymin, xmax, ymax FROM {features} WHERE layer <> 'PROMO'"


@query(
    "geoj7_line_in_layers",
    f"""WITH h AS (SELECT edge_region, layer, factor, distance_km / 100 * (CASE WHEN y0 = y1 THEN greatest(least(greatest(x0, x1), xmax) - greatest(least(x0, x1), xmin), 0) ELSE greatest(least(greatest(y0, y1), ymax) - greatest(least(y0, y1), ymin), 0) END) / (CASE WHEN y0 = y1 THEN abs(x1 - x0) ELSE abs(y1 - y0) END) AS l
      FROM (SELECT * FROM {{edges}}) e, (SELECT * FROM ({_LAYERS})) r WHERE (y0 = y1 AND y0 BETWEEN ymin AND ymax) OR (x0 = x1 AND x0 BETWEEN xmin AND xmax))
    SELECT edge_region, layer, round(sum(l), 6) AS length, round(sum(l * factor), 6) AS penalty FROM h WHERE l > 1e-12 GROUP BY edge_region, layer""",
)
def _(t: Tables) -> DataFrame:
    out = S.line_in_layers(t("edges"), t.sql(_LAYERS), 5.0, "edge_region").where("length > 1e-12")
    return out.select("edge_region", "layer", *r6("length", "penalty"))


@query("geoj8_segment_cells")
def _(t: Tables) -> DataFrame:
    return S.segment_cells(t("segments"), 5.0, "segment_id")


@query("geoj9_centre_population", f"SELECT code, round(coalesce(sum(value), 0), 4) AS population FROM {{zones}} LEFT JOIN (SELECT min(code) AS code, any_value(value) AS value FROM ({_P}) p, {{zones}} WHERE x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax GROUP BY point_id) USING (code) GROUP BY code")
def _(t: Tables) -> DataFrame:
    own = S.points_in_rectangles(t.sql(_P), t("zones"), 20.0).groupBy("code").agg(F.sum("value").alias("population"))
    return t("zones").select("code").join(own, "code", "left").select("code", F.round(F.coalesce("population", F.lit(0.0)), 4).alias("population"))


@query("grf1_neighbours", "SELECT region, direction, neighbour FROM {neighbours}")
def _(t: Tables) -> DataFrame:
    return H.rook_neighbours(t("cells"))


@query("grf2_neighbour_counts", "SELECT region, count(*) FILTER (neighbour <> 'R-999') AS n, count(*) FILTER (neighbour <> 'R-999') = 0 AS isolated FROM {neighbours} GROUP BY region")
def _(t: Tables) -> DataFrame:
    return H.neighbour_counts(H.rook_neighbours(t("cells")))


@query("grf3_directed_edges", "SELECT edge_region, region_from, region_to, direction, round(distance_km, 6) AS distance_km FROM {edges}")
def _(t: Tables) -> DataFrame:
    d = F.sqrt(F.pow(F.col("cx_from") - F.col("cx_to"), 2) + F.pow(F.col("cy_from") - F.col("cy_to"), 2)) * 100
    return H.directed_edges(H.rook_neighbours(t("cells")), t("cells"), d).select("edge_region", "region_from", "region_to", "direction", *r6("distance_km"))


@query("grf4_graph_contract", "SELECT 'unique_regions' AS \"check\", count(*) = count(DISTINCT region) AS passed FROM {cells} UNION ALL SELECT 'unique_centres', count(*) = count(DISTINCT (cx, cy)) FROM {cells} UNION ALL SELECT 'single_jurisdiction', count(DISTINCT jurisdiction) = 1 FROM {cells}")
def _(t: Tables) -> DataFrame:
    return H.graph_contract(t("cells"), ["jurisdiction"])


@query(
    "grf5_mirrored",
    "SELECT edge_region, concat(least(region_from, region_to), '--', greatest(region_from, region_to)) AS undirected, CASE WHEN region_from < region_to THEN region_from ELSE region_to END AS kept FROM {edges}",
)
def _(t: Tables) -> DataFrame:
    return H.on_first_edge(t("edges"), lambda df: df.withColumn("kept", F.col("region_from"))).select("edge_region", "undirected", "kept")


ADAPTERS["impedance"] = """
    SELECT e.edge_region, e.region_from, e.region_to, distance_km, coalesce(p, 0e0) AS penalty, distance_km + coalesce(p, 0e0) AS effective_km, (distance_km + coalesce(p, 0e0)) / distance_km AS multiplier FROM (SELECT * FROM {edges}) e
    LEFT JOIN (SELECT region, sum(n) * 1e0 AS p FROM (SELECT CAST(floor((lon + 145) / 5) AS INT) AS ix, CAST(floor((lat - 40) / 5) AS INT) AS iy, count(*) AS n FROM {points} GROUP BY 1, 2) q JOIN (SELECT ix AS i, iy AS j, region FROM {cells}) c ON q.ix = c.i AND q.iy = c.j WHERE n > 5 GROUP BY region) r ON r.region = e.region_from"""


@query("grf6_cost_distance", "SELECT edge_region, round(effective_km, 6) AS effective_km, round(multiplier, 6) AS multiplier, round(penalty / effective_km, 6) AS penalty_share FROM {impedance}")
def _(t: Tables) -> DataFrame:
    rows = t("impedance")
    penalties = rows.where("penalty > 0").select("edge_region", (F.col("penalty") / 2).alias("penalty"))
    return H.cost_distance(t("edges"), penalties.unionAll(penalties)).select("edge_region", *r6("effective_km", "multiplier", "penalty_share"))


@query("grf7_impedance_summary", "SELECT region_from, count(*) AS n_edges, round(sum(distance_km), 6) AS physical_km, round(sum(effective_km), 6) AS effective_km, round(avg(multiplier), 6) AS mean_multiplier, round(max(multiplier), 6) AS max_multiplier, count(*) FILTER (penalty > 0) AS n_penalised FROM {impedance} GROUP BY region_from")
def _(t: Tables) -> DataFrame:
    return H.impedance_summary(t("impedance"), "region_from").select("region_from", "n_edges", *r6("physical_km", "effective_km", "mean_multiplier", "max_multiplier"), "n_penalised")


#: What each layer adds to an edge; an edge may meet a layer more than once, or not at all.
_ADDED = "SELECT edge_region, CASE WHEN ix % 3 = 0 THEN 'water' WHEN ix % 3 = 1 THEN 'land' ELSE 'people' END AS layer, (iy + k) * 1.5e0 AS penalty FROM {edges} JOIN (SELECT region, ix, iy FROM {cells}) c ON c.region = region_from CROSS JOIN (VALUES (0), (1)) AS v(k) WHERE direction <> 'left'"
_IMPEDED = f"SELECT e.edge_region, region_from, distance_km, coalesce(p, 0e0) AS penalty, distance_km + coalesce(p, 0e0) AS effective_km, (distance_km + coalesce(p, 0e0)) / distance_km AS multiplier FROM (SELECT * FROM {{edges}}) e LEFT JOIN (SELECT edge_region, sum(penalty) AS p FROM ({_ADDED}) GROUP BY edge_region) a ON a.edge_region = e.edge_region"


@query(
    "grf7_layer_sums",
    f"""SELECT region_from, count(*) AS n_edges, round(sum(distance_km), 6) AS physical_km, round(sum(effective_km), 6) AS effective_km, round(avg(multiplier), 6) AS mean_multiplier, round(max(multiplier), 6) AS max_multiplier, count(*) FILTER (penalty > 0) AS n_penalised,
      round(coalesce(sum(w), 0), 6) AS water_km, round(coalesce(sum(l), 0), 6) AS land_km, round(coalesce(sum(q), 0), 6) AS people_km FROM ({_IMPEDED}) i LEFT JOIN (SELECT edge_region AS er, sum(penalty) FILTER (layer = 'water') AS w, sum(penalty) FILTER (layer = 'land') AS l, sum(penalty) FILTER (layer = 'people') AS q FROM ({_ADDED}) GROUP BY 1) ON er = edge_region GROUP BY region_from""",
)
def _(t: Tables) -> DataFrame:
    out = H.impedance_summary(H.cost_distance(t("edges"), t.sql(_ADDED)), "region_from", penalties=t.sql(_ADDED), layers=("water", "land", "people"))
    return out.select("region_from", "n_edges", *r6("physical_km", "effective_km", "mean_multiplier", "max_multiplier"), "n_penalised", *r6("water_km", "land_km", "people_km"))


@query("geo4_metadata", "SELECT region, cx AS lon, cy AS lat, 5e0 AS resolution, 'degrees' AS resolution_unit, 'EPSG:4326' AS crs, concat(printf('%.4f', cy), ',', printf('%.4f', cx)) AS site FROM {cells}")
def _(t: Tables) -> DataFrame:
    own = S.region_metadata(S.dense_regions(t("cells").drop("region")), SIZE, "degrees", "EPSG:4326")
    return own.select("region", "lon", "lat", "resolution", "resolution_unit", "crs", "site")


@query("grf8_scoped", "SELECT edge_region, round(effective_km, 6) AS capex_km, round(distance_km, 6) AS fixed_km, round(distance_km, 6) AS variable_km FROM {impedance}")
def _(t: Tables) -> DataFrame:
    return H.scoped_distances(t("impedance"), "etl_capex_only").select("edge_region", *r6("capex_km", "fixed_km", "variable_km"))


@query("grf8_coverage", "SELECT edge_region, 'missing' AS reason FROM {edges} WHERE direction = 'up'")
def _(t: Tables) -> DataFrame:
    return H.coverage(t("edges"), t("impedance").join(t("edges").where("direction <> 'up'").select("edge_region"), "edge_region"))


_CLASSES = "SELECT DISTINCT o_orderpriority AS class, 'backbone' AS network FROM {orders} WHERE o_orderpriority LIKE '1%' UNION ALL SELECT DISTINCT o_orderpriority, 'primary' FROM {orders} WHERE o_orderpriority < '3'"


@query("grf10_networks", f"SELECT network, jurisdiction, count(*) AS n FROM {{segments}} JOIN ({_CLASSES}) k USING (class) GROUP BY network, jurisdiction")
def _(t: Tables) -> DataFrame:
    return H.network_classes(t("segments"), t.sql(_CLASSES)).groupBy("network", "jurisdiction").agg(F.count("*").alias("n"))


@query("grf11_unique_geometry", "SELECT segment_id FROM (SELECT segment_id, row_number() OVER (PARTITION BY x0, y0, x1, y1 ORDER BY class, jurisdiction, segment_id) AS n FROM {segments}) WHERE n = 1")
def _(t: Tables) -> DataFrame:
    return H.unique_geometry(t("segments"), ["x0", "y0", "x1", "y1"], "class", "jurisdiction", "segment_id").select("segment_id")


@query("grf12_geometry_quality", "SELECT count(*) AS n, 0::BIGINT AS n_null, count(*) FILTER (x0 = x1 AND y0 = y1) AS n_empty, count(*) - count(DISTINCT (x0, y0, x1, y1)) AS n_repeated FROM {segments}")
def _(t: Tables) -> DataFrame:
    return H.geometry_quality(t("segments"), ["x0", "y0", "x1", "y1"])


@query("grf13_class_counts", "SELECT jurisdiction, class, count(*) AS n FROM {segments} GROUP BY jurisdiction, class")
def _(t: Tables) -> DataFrame:
    return H.class_counts(t("segments"), "jurisdiction", "class")


@query("grf14_network_summary", "SELECT CASE WHEN grouping(jurisdiction) = 1 THEN 'STUDY_AREA' ELSE CAST(jurisdiction AS STRING) END AS jurisdiction, count(*) AS n, count(*) FILTER (class < '2') AS backbone, round(100.0 * count(*) FILTER (class < '2') / count(*), 1) AS backbone_pct FROM {segments} GROUP BY ROLLUP (jurisdiction)")
def _(t: Tables) -> DataFrame:
    return H.network_summary(t("segments").withColumn("backbone", F.col("class") < "2"), "jurisdiction", ["backbone"])


_SIDES = (("x0 - x1", "x0 - xmin"), ("x1 - x0", "xmax - x0"), ("y0 - y1", "y0 - ymin"), ("y1 - y0", "ymax - y0"))
_ENTER = ", ".join(f"CASE WHEN {p} < 0 THEN ({q}) / nullif({p}, 0) WHEN {p} = 0 AND {q} < 0 THEN 2e0 ELSE 0e0 END" for p, q in _SIDES)
_LEAVE = ", ".join(f"CASE WHEN {p} > 0 THEN ({q}) / nullif({p}, 0) WHEN {p} = 0 AND {q} < 0 THEN -1e0 ELSE 1e0 END" for p, q in _SIDES)
#: A row for each cell that a segment touches (to a billionth of it); four order keys in a row are a road. The queries get the same by segment_cells.
ADAPTERS["road_cells"] = f"""
    SELECT CAST(floor(segment_id / 4) AS BIGINT) AS road_id, region FROM (SELECT segment_id, x0, y0, x1, y1 FROM {{segments}}) s JOIN (SELECT ix, iy, region, x0 AS xmin, y0 AS ymin, x1 AS xmax, y1 AS ymax FROM {{cells}}) c
    ON c.ix BETWEEN floor(least(s.x0, s.x1) / 5) + 29 AND floor(greatest(s.x0, s.x1) / 5) + 29 AND c.iy BETWEEN floor(least(s.y0, s.y1) / 5) - 8 AND floor(greatest(s.y0, s.y1) / 5) - 8
    WHERE greatest(0e0, {_ENTER}) <= least(1e0, {_LEAVE}) + 1e-9"""


def _road_cells(t: Tables) -> DataFrame:
    touched = S.segment_cells(t("segments"), float(SIZE), "segment_id").select(F.floor(F.col("segment_id") / 4).alias("road_id"), (F.col("ix") + 29).alias("ix"), (F.col("iy") - 8).alias("iy"))
    return touched.join(t("cells").select("ix", "iy", "region"), ["ix", "iy"]).select("road_id", "region")


@query("grf15_road_presence", "SELECT region, count(DISTINCT road_id) AS n_roads, count(road_id) AS n_crossings, count(road_id) > 0 AS has_road FROM (SELECT region FROM {cells}) LEFT JOIN {road_cells} USING (region) GROUP BY region")
def _(t: Tables) -> DataFrame:
    return H.road_presence(t("cells"), _road_cells(t))


@query("grf16_weak_connection", "SELECT edge_region, region_from IN (SELECT region FROM {road_cells}) AND region_to IN (SELECT region FROM {road_cells}) AS connected FROM {edges}")
def _(t: Tables) -> DataFrame:
    return H.weak_connection(t("edges"), H.road_presence(t("cells"), _road_cells(t))).select("edge_region", "connected")


@query(
    "grf9_canonical_links",
    """SELECT DISTINCT 'node' AS kind, region FROM {cells} UNION ALL SELECT DISTINCT 'pipeline', edge_region FROM {edges}
    UNION ALL SELECT DISTINCT 'truck', edge_region FROM {edges} WHERE region_from IN (SELECT region FROM {road_cells}) AND region_to IN (SELECT region FROM {road_cells})""",
)
def _(t: Tables) -> DataFrame:
    connected = H.weak_connection(t("edges"), H.road_presence(t("cells"), _road_cells(t)))
    return H.canonical_links(t("cells"), t("edges"), connected)


@query("grf17_strong_connection", "SELECT region_from, region_to, count(DISTINCT a.road_id) AS n_shared, count(DISTINCT a.road_id) > 0 AS connected FROM (SELECT * FROM {edges}) e LEFT JOIN ((SELECT * FROM {road_cells}) a JOIN (SELECT region AS r2, road_id AS q FROM {road_cells}) b ON a.road_id = b.q) ON a.region = region_from AND b.r2 = region_to GROUP BY region_from, region_to")
def _(t: Tables) -> DataFrame:
    return H.strong_connection(t("edges"), _road_cells(t))


@query(
    "grf18_process_network",
    """WITH l AS (SELECT DISTINCT region, period, input_comm, tech, vintage, output_comm FROM {efficiency} JOIN (SELECT DISTINCT region, period, tech, vintage FROM {net_capacity}) USING (region, tech, vintage))
    SELECT * FROM l WHERE region NOT LIKE '%-%' UNION ALL SELECT split_part(region, '-', 1), period, input_comm, tech, vintage, concat(output_comm, '@', split_part(region, '-', 2)) FROM l WHERE region LIKE '%-%' UNION ALL SELECT split_part(region, '-', 2), period, concat(input_comm, '@', split_part(region, '-', 1)), tech, vintage, output_comm FROM l WHERE region LIKE '%-%'""",
)
def _(t: Tables) -> DataFrame:
    return H.process_network(t("efficiency"), t("net_capacity")).select("region", "period", "input_comm", "tech", "vintage", "output_comm")


#: A layered network with cycles: commodities c0 … c9, made of part keys.
_LINKS = "SELECT DISTINCT concat('R', CAST(p_size % 3 AS STRING)) AS region, 1995 AS period, concat('c', CAST(p_partkey % 23 AS STRING)) AS input_comm, p_brand AS tech, 1990 AS vintage, concat('c', CAST((p_partkey % 23 * 3 + p_size % 5) % 29 AS STRING)) AS output_comm FROM {part}"


def _trace(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    links = t.sql(_LINKS)
    ends = links.select("region", "period").distinct()
    return links, ends.withColumn("commodity", F.lit("c1")), ends.withColumn("commodity", F.lit("c28"))


@query(
    "grf19_source_trace",
    f"""WITH RECURSIVE l AS ({_LINKS}), b AS (SELECT DISTINCT region, 'c28' AS c FROM l UNION SELECT l.region, l.input_comm FROM l JOIN b ON l.region = b.region AND l.output_comm = b.c),
    k AS (SELECT l.* FROM l JOIN b ON l.region = b.region AND l.output_comm = b.c), f AS (SELECT DISTINCT region, 'c1' AS c FROM l UNION SELECT k.region, k.output_comm FROM k JOIN f ON k.region = f.region AND k.input_comm = f.c)
    SELECT k.region, period, input_comm, tech, vintage, output_comm FROM k JOIN f ON k.region = f.region AND k.input_comm = f.c""",
)
def _(t: Tables) -> DataFrame:
    return H.source_trace(*_trace(t)).select("region", "period", "input_comm", "tech", "vintage", "output_comm")


@query(
    "grf20_orphans",
    f"""WITH RECURSIVE l AS ({_LINKS}), b AS (SELECT DISTINCT region, 'c28' AS c FROM l UNION SELECT l.region, l.input_comm FROM l JOIN b ON l.region = b.region AND l.output_comm = b.c),
    k AS (SELECT l.* FROM l JOIN b ON l.region = b.region AND l.output_comm = b.c), f AS (SELECT DISTINCT region, 'c1' AS c FROM l UNION SELECT k.region, k.output_comm FROM k JOIN f ON k.region = f.region AND k.input_comm = f.c)
    SELECT l.*, CASE WHEN (l.region, l.output_comm) IN (SELECT (region, c) FROM b) THEN 'demand_side' ELSE 'other' END AS class FROM l WHERE (l.region, l.output_comm) NOT IN (SELECT (region, c) FROM b) OR (l.region, l.input_comm) NOT IN (SELECT (region, c) FROM f)""",
)
def _(t: Tables) -> DataFrame:
    return H.orphans(*_trace(t))


@query("grf20_pruned")
def _(t: Tables) -> DataFrame:
    return H.prune_orphans(*_trace(t), process=("region", "tech", "vintage", "input_comm", "output_comm"))[0].select("region", "period", "input_comm", "tech", "vintage", "output_comm")


@query(
    "grf21_linked",
    """WITH p AS (SELECT DISTINCT region, tech FROM {net_capacity} WHERE capacity > 199), l AS (SELECT DISTINCT region, tech AS driver, concat('Brand#', CAST(CAST(replace(tech, 'Brand#', '') AS INT) % 25 + 1 AS STRING)) AS driven FROM {net_capacity})
    SELECT region, driver, driven, CASE WHEN a AND b THEN 'both' WHEN b THEN 'driver removed' WHEN a THEN 'driven removed' ELSE 'both removed' END AS status FROM (SELECT *, (region, driver) IN (SELECT (region, tech) FROM p) AS a, (region, driven) IN (SELECT (region, tech) FROM p) AS b FROM l)""",
)
def _(t: Tables) -> DataFrame:
    linked = t.sql("SELECT DISTINCT region, tech AS driver, concat('Brand#', CAST(CAST(replace(tech, 'Brand#', '') AS INT) % 25 + 1 AS STRING)) AS driven FROM {net_capacity}")
    return H.linked_prescreen(linked, t("net_capacity").where("capacity > 199")).select("region", "driver", "driven", "status")


@query("grf22_unsupported", "SELECT region, period, commodity FROM {demand} WHERE (region, period, commodity) NOT IN (SELECT (region, period, output_comm) FROM {flow_out} WHERE flow > 120)")
def _(t: Tables) -> DataFrame:
    return H.unsupported(t("demand"), t("flow_out").where("flow > 120")).select("region", "period", "commodity")


_MAYBE = "SELECT CASE WHEN vintage = 1990 THEN 'global' WHEN vintage = 1995 AND region LIKE '%-%' THEN concat(region, '+R9') ELSE region END AS region, tech, vintage, cost FROM {cost_invest}"


@query("grf23_viable", f"WITH k AS (SELECT region, tech FROM {{net_capacity}} WHERE capacity > 198) SELECT region, tech, vintage, round(cost, 6) AS cost FROM ({_MAYBE}) WHERE CASE WHEN region = 'global' OR region LIKE '%+%' THEN tech IN (SELECT tech FROM k) ELSE (region, tech) IN (SELECT (region, tech) FROM k) END")
def _(t: Tables) -> DataFrame:
    return H.viable(t.sql(_MAYBE), t("net_capacity").where("capacity > 198"), ["region", "tech"]).select("region", "tech", "vintage", *r6("cost"))


_ROUTES = "SELECT DISTINCT region, CASE WHEN length(tech) = 7 THEN 'pipe' ELSE 'road' END AS mode, tech AS name FROM {net_capacity} WHERE region LIKE '%-%' AND capacity > 199"


@query(
    "grf24_corridors",
    f"""SELECT region, name, place, n, modes, CASE WHEN split_part(region, '-', 1) > split_part(region, '-', 2) THEN -o ELSE o END AS "offset" FROM (SELECT *, greatest(-4e0, least(4e0, (place - (n + 1) / 2e0) * 0.5)) AS o FROM (SELECT region, name, row_number() OVER (PARTITION BY r ORDER BY CASE mode WHEN 'pipe' THEN 1 ELSE 2 END, name, region) AS place, count(*) OVER (PARTITION BY r) AS n, array_to_string(list_sort(list_distinct(list(mode) OVER (PARTITION BY r))), ',') AS modes
    FROM (SELECT *, concat(least(split_part(region, '-', 1), split_part(region, '-', 2)), '--', greatest(split_part(region, '-', 1), split_part(region, '-', 2))) AS r FROM ({_ROUTES}))))""",
)
def _(t: Tables) -> DataFrame:
    order = t.sql("SELECT DISTINCT CASE WHEN length(tech) = 7 THEN 'pipe' ELSE 'road' END AS mode, CASE WHEN length(tech) = 7 THEN 1 ELSE 2 END AS rank FROM {technology}")
    return H.corridor_ranks(t.sql(_ROUTES), order, 0.5, 4.0).select("region", "name", F.col("place").cast("long").alias("place"), "n", "modes", "offset")


@query(
    "grf25_balance_set",
    """SELECT CASE WHEN region LIKE '%-%' THEN split_part(region, '-', 2) ELSE region END AS region, period, output_comm AS commodity FROM {flow_out} INTERSECT SELECT CASE WHEN region LIKE '%-%' THEN split_part(region, '-', 1) ELSE region END, period, input_comm FROM (SELECT region, period, CASE WHEN input_comm = 'PROMO' THEN '2-HIGH' ELSE input_comm END AS input_comm FROM {flow_out})""",
)
def _(t: Tables) -> DataFrame:
    return H.balance_set(t("flow_out").withColumn("input_comm", F.when(F.col("input_comm") == "PROMO", "2-HIGH").otherwise(F.col("input_comm"))))


@query("grf26_exchange_maps", "SELECT split_part(region, '-', 1) AS exporter, output_comm, count(DISTINCT (split_part(region, '-', 2), tech)) AS n FROM {flow_out} WHERE region LIKE '%-%' GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return H.exchange_maps(t("flow_out")).select("exporter", "output_comm", F.size("importers").cast("long").alias("n"))


@query("geo6_boundaries", "SELECT code, xmin, ymin, xmax, ymax FROM {zones} WHERE code IN ('Z1', 'Z7', 'Z12')")
def _(t: Tables) -> DataFrame:
    return S.select_boundaries(t("zones"), ["Z1", "Z7", "Z12"]).select("code", "xmin", "ymin", "xmax", "ymax")


_SMALL = "SELECT feature_id, xmin, ymin, xmax, ymax FROM {features}"


@query(
    "geo10_dissolve",
    f"""WITH RECURSIVE f AS ({_SMALL}), l AS (SELECT a.feature_id AS a, b.feature_id AS b FROM f a, f b WHERE a.feature_id <> b.feature_id AND least(a.xmax, b.xmax) > greatest(a.xmin, b.xmin) AND least(a.ymax, b.ymax) > greatest(a.ymin, b.ymin)),
    r AS (SELECT feature_id AS k, feature_id AS c FROM f UNION SELECT l.a, r.c FROM l JOIN r ON l.b = r.k) SELECT component, count(*) AS n, round(sum((xmax - xmin) * (ymax - ymin)), 6) AS summed FROM (SELECT k, min(c) AS component FROM r GROUP BY k) JOIN f ON k = feature_id GROUP BY component""",
)
def _(t: Tables) -> DataFrame:
    return S.dissolve(t.sql(_SMALL), 5.0, "feature_id").select("component", "n", *r6("summed"))


@query("geo10_dissolved_area")
def _(t: Tables) -> DataFrame:
    return S.dissolve(t("features"), 5.0, "feature_id").select("component", *r6("dissolved"))


@query(
    "geo11_clip",
    """SELECT feature_id, round(any_value(s), 6) AS source, round(sum(a), 6) AS clipped FROM (SELECT f.feature_id, (f.xmax - f.xmin) * (f.ymax - f.ymin) AS s, greatest(least(z.xmax, f.xmax) - greatest(z.xmin, f.xmin), 0) * greatest(least(z.ymax, f.ymax) - greatest(z.ymin, f.ymin), 0) AS a FROM (SELECT * FROM {features}) f, (SELECT * FROM {zones}) z) WHERE a > 0 GROUP BY feature_id""",
)
def _(t: Tables) -> DataFrame:
    f = t("features")
    return S.clip_tiles(f.unionByName(f.where("feature_id % 3 = 0")), t("zones"), 20.0, "feature_id").select("feature_id", *r6("source", "clipped"))


@query("geo13_edge_lines", "SELECT edge_region, x0, y0, x1, y1 FROM {edges}")
def _(t: Tables) -> DataFrame:
    return H.edge_lines(t("edges").select("edge_region", "region_from", "region_to"), t("cells")).select("edge_region", "x0", "y0", "x1", "y1")
