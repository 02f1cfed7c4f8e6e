"""Queries over layers of general polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators import polygons as G
from gridloom.operators.joins import r6
from gridloom.plans.adapters import ADAPTERS, Tables
from gridloom.plans.catalog import query
from gridloom.session import materialize

# a concave border with a hole, a second part and one of no area; points repeat, and every other polygon turns the other way; they lie off the points' grid, so that
# nothing lies on a border
_SHAPE = (
    [(0, 0, x, y) for x, y in ((0, 0), (16, 1), (16, 1), (12, 4), (15, 7), (7, 5), (1, 7), (4, 3.5), (0, 0))]
    + [(0, 1, x, y) for x, y in ((5, 2), (8, 2.25), (7.5, 4), (5.25, 3.5))]
    + [(1, 0, x, y) for x, y in ((16.25, 5), (17.5, 5.5), (16.75, 7.25))]
    + [(2, 0, x, y) for x, y in ((0, 0), (1, 1))]
)
_VALUES = ", ".join(f"({p}, {r}, {k}, {x}e0, {y}e0)" for k, (p, r, x, y) in enumerate(_SHAPE))
ADAPTERS["vertices"] = f"""
    SELECT concat(pre, CAST(n_nationkey AS STRING)) AS code, part, ring, CASE WHEN n_nationkey % 2 = 1 THEN -seq ELSE seq END AS seq, -144.9986280652e0 + (n_nationkey % 5) * 18 + sx + dx AS x, 41.0007312973e0 + floor(n_nationkey / 5) * 8 + sy + dy AS y, layer, factor, constant
    FROM {{nation}} CROSS JOIN (VALUES {_VALUES}) AS v(part, ring, seq, dx, dy) CROSS JOIN (VALUES ('Z', 0e0, 0e0, 'water', 9e0, true), ('Y', 2e0, 1e0, 'water', 9e0, true), ('X', -3e0, 0.5e0, 'land', 0.5e0, false), ('W', -3e0, 0.5e0, 'land', 0.25e0, false)) AS k(pre, sx, sy, layer, factor, constant)"""
# the same polygons on the points' grid, where points and lines meet borders
ADAPTERS["grid_vertices"] = ADAPTERS["vertices"].replace("-144.9986280652e0", "-145e0").replace("41.0007312973e0", "41e0")
ADAPTERS["boxes"] = """
    SELECT CAST(feature_id AS STRING) AS code, 0 AS part, 0 AS ring, k AS seq, CASE WHEN k IN (0, 3) THEN xmin ELSE xmax END AS x, CASE WHEN k < 2 THEN ymin ELSE ymax END AS y FROM {features} CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(k)"""
# the same sides in SQL
_SIDES = """SELECT code, part, ring, CASE WHEN t THEN x1 ELSE x END AS x0, CASE WHEN t THEN y1 ELSE y END AS y0, CASE WHEN t THEN x ELSE x1 END AS x1, CASE WHEN t THEN y ELSE y1 END AS y1, t AS turned, abs(a) AS area FROM (
      SELECT *, (a < 0) = (ring = 0) AS t FROM (SELECT *, sum(x * y1 - x1 * y) OVER (PARTITION BY code, part, ring) / 2 AS a, count(*) OVER (PARTITION BY code, part, ring) AS n FROM (
        SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1 FROM (
          SELECT *, lag(x) OVER (PARTITION BY code, part, ring ORDER BY seq) AS px, lag(y) OVER (PARTITION BY code, part, ring ORDER BY seq) AS py FROM TABLE_) WHERE px IS NULL OR px <> x OR py <> y
        WINDOW w AS (PARTITION BY code, part, ring ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE x <> x1 OR y <> y1) WHERE n >= 3 AND abs(a) > 1e-12)"""
_OWN, _BOXES, _GRID = (_SIDES.replace("TABLE_", name) for name in ("{vertices}", "{boxes}", "{grid_vertices}"))
_ODD = "count(*) FILTER ((y0 <= PY) <> (y1 <= PY) AND PX < x0 + (PY - y0) * (x1 - x0) / (y1 - y0)) % 2 = 1"
_P = "SELECT point_id, lon AS px, lat AS py, value FROM {points}"


@query("geo9_normalised", f"SELECT code, part, ring, count(*) AS n, any_value(turned) AS turned, round(any_value(area), 6) AS area FROM ({_OWN}) GROUP BY code, part, ring")
def _(t: Tables) -> DataFrame:
    return G.normalised(t("vertices")).groupBy("code", "part", "ring").agg(F.count("*").alias("n"), F.first("turned").alias("turned"), F.round(F.first("area"), 6).alias("area"))


_HELD = f"SELECT point_id, any_value(value) AS value, code FROM ({_P}) p, ({_GRID}) s GROUP BY point_id, code HAVING {_ODD}".replace("PX", "px").replace("PY", "py")


@query("geoj1_true_polygons", f"SELECT point_id, min(code) AS code FROM ({_HELD}) GROUP BY point_id")
def _(t: Tables) -> DataFrame:
    return G.points_in_polygons(t.sql(_P), G.layer(t("grid_vertices")), 10.0, "px", "py").select("point_id", "code")


@query("geo3_true_retained", f"SELECT DISTINCT region FROM (SELECT region, code FROM (SELECT region, cx, cy FROM {{cells}}) c, ({_GRID}) s GROUP BY region, code HAVING {_ODD})".replace("PX", "any_value(cx)").replace("PY", "any_value(cy)").replace("any_value(cx)", "cx").replace("any_value(cy)", "cy"))
def _(t: Tables) -> DataFrame:
    return G.points_in_polygons(t("cells"), G.layer(t("grid_vertices")), 10.0, "cx", "cy", "region").select("region")


@query("geoj9_true_population", f"SELECT code, round(coalesce(sum(value), 0), 4) AS population FROM (SELECT DISTINCT code FROM {{grid_vertices}}) LEFT JOIN (SELECT min(code) AS code, any_value(value) AS value FROM ({_HELD}) GROUP BY point_id) USING (code) GROUP BY code")
def _(t: Tables) -> DataFrame:
    own = G.points_in_polygons(t.sql(_P), G.layer(t("grid_vertices")), 10.0, "px", "py").groupBy("code").agg(F.sum("value").alias("population"))
    return t("grid_vertices").select("code").distinct().join(own, "code", "left").select("code", F.round(F.coalesce("population", F.lit(0.0)), 4).alias("population"))


@query(
    "geoj2_true_polygons",
    f"""WITH d AS (SELECT point_id, code, CASE WHEN {_ODD} THEN 0 ELSE min(sqrt(pow(px - x0 - t * (x1 - x0), 2) + pow(py - y0 - t * (y1 - y0), 2))) END AS d
      FROM (SELECT *, least(greatest(((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / (pow(x1 - x0, 2) + pow(y1 - y0, 2)), 0), 1) AS t FROM ({_P}) p, ({_OWN}) s) GROUP BY point_id, code),
    r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, code) AS n FROM d WHERE d <= 0.75)
    SELECT p.point_id, code, round(d, 6) AS distance, CASE WHEN code IS NULL THEN 'none' WHEN d > 0 THEN 'nearest' ELSE 'within' END AS matched_by FROM ({_P}) p LEFT JOIN (SELECT * FROM r WHERE n = 1) USING (point_id)""".replace("PX", "px").replace("PY", "py"),
)
def _(t: Tables) -> DataFrame:
    return G.within_or_nearest_polygon(t.sql(_P), G.layer(t("vertices")), 0.75, "px", "py").select("point_id", "code", *r6("distance"), "matched_by")


_UNDER = """least(ya + (yb - ya) * (lo - xa) / (xb - xa), yc + (yd - yc) * (lo - xc) / (xd - xc)) AS u, least(ya + (yb - ya) * (hi - xa) / (xb - xa), yc + (yd - yc) * (hi - xc) / (xd - xc)) AS v,
    (ya + (yb - ya) * (lo - xa) / (xb - xa)) - (yc + (yd - yc) * (lo - xc) / (xd - xc)) AS p, (ya + (yb - ya) * (hi - xa) / (xb - xa)) - (yc + (yd - yc) * (hi - xc) / (xd - xc)) AS q"""


@query(
    "geoj6_true_polygons",
    f"""WITH a AS ({_OWN}), b AS ({_BOXES}), wa AS (SELECT code, sum(x0 * y1 - x1 * y0) / 2 AS w, min(x0) AS x, max(x0) AS X1, min(y0) AS y, max(y0) AS Y1 FROM a GROUP BY code), wb AS (SELECT code, sum(x0 * y1 - x1 * y0) / 2 AS w, min(x0) AS x, max(x0) AS X1, min(y0) AS y, max(y0) AS Y1 FROM b GROUP BY code),
    m AS (SELECT wa.code AS l, wb.code AS r, wa.w AS lw, wb.w AS rw FROM wa, wb WHERE wa.x < wb.X1 AND wb.x < wa.X1 AND wa.y < wb.Y1 AND wb.y < wa.Y1),
    e AS (SELECT l, r, lw, rw, a.x0 AS xa, a.y0 AS ya, a.x1 AS xb, a.y1 AS yb, b.x0 AS xc, b.y0 AS yc, b.x1 AS xd, b.y1 AS yd, greatest(least(a.x0, a.x1), least(b.x0, b.x1)) AS lo, least(greatest(a.x0, a.x1), greatest(b.x0, b.x1)) AS hi
      FROM m JOIN a ON a.code = l JOIN b ON b.code = r WHERE a.x0 <> a.x1 AND b.x0 <> b.x1),
    s AS (SELECT l, r, any_value(lw) AS lw, any_value(rw) AS rw, sum(sign(xb - xa) * sign(xd - xc) * (hi - lo) * ((u + v) / 2 + CASE WHEN p * q < 0 THEN abs(p * q) / (abs(p) + abs(q)) / 2 ELSE 0 END)) AS area FROM (SELECT *, {_UNDER} FROM e WHERE hi > lo) GROUP BY l, r)
    SELECT l AS "left", r AS "right", round(area, 8) AS area, round(least(area / lw, 1), 8) AS left_share, round(least(area / rw, 1), 8) AS right_share FROM s WHERE area > 1e-9""",
)
def _(t: Tables) -> DataFrame:
    out = G.overlay_polygons(G.layer(t("vertices")), G.layer(t("boxes")), 10.0).where("area > 1e-9")
    return out.select("left", "right", F.round("area", 8).alias("area"), F.round("left_share", 8).alias("left_share"), F.round("right_share", 8).alias("right_share"))


_TS = "CASE WHEN (bx - ax) * (s.y1 - s.y0) <> (by_ - ay) * (s.x1 - s.x0) THEN ((s.x1 - s.x0) * (s.y0 - ay) - (s.y1 - s.y0) * (s.x0 - ax)) / ((s.x1 - s.x0) * (by_ - ay) - (bx - ax) * (s.y1 - s.y0)) END"


@query(
    "geoj7_true_polygons",
    f"""WITH s AS (SELECT s.*, layer, factor, constant FROM ({_GRID}) s JOIN (SELECT DISTINCT code, layer, factor, constant FROM {{grid_vertices}}) USING (code)), b AS (SELECT code, min(x0) AS bx0, max(x0) AS bx1, min(y0) AS by0, max(y0) AS by1 FROM s GROUP BY code),
    l AS (SELECT segment_id, x0 AS ax, y0 AS ay, x1 AS bx, y1 AS by_ FROM {{segments}}),
    m AS (SELECT l.*, code FROM l, b WHERE least(ax, bx) <= bx1 AND greatest(ax, bx) >= bx0 AND least(ay, by_) <= by1 AND greatest(ay, by_) >= by0),
    ts AS (SELECT DISTINCT segment_id, code, t FROM (SELECT segment_id, code, unnest([0.0, 1.0]) AS t FROM m UNION ALL SELECT segment_id, m.code, {_TS} AS t FROM m JOIN s USING (code)) WHERE t BETWEEN 0 AND 1),
    c AS (SELECT segment_id, code, t AS lo, lead(t) OVER (PARTITION BY segment_id, code ORDER BY t) AS hi FROM ts),
    h AS (SELECT segment_id, code, lo, hi, any_value(bx - ax) AS dx, any_value(by_ - ay) AS dy FROM (SELECT c.*, ax, ay, bx, by_, ax + (lo + hi) / 2 * (bx - ax) AS qx, ay + (lo + hi) / 2 * (by_ - ay) AS qy FROM c JOIN m USING (segment_id, code) WHERE hi - lo > 1e-12) JOIN s USING (code) GROUP BY segment_id, code, lo, hi, qx, qy HAVING {_ODD}),
    k AS (SELECT segment_id, layer, factor, lo, hi, sqrt(dx * dx + dy * dy) AS len, constant, max(hi) OVER (PARTITION BY segment_id, layer ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h JOIN (SELECT DISTINCT code, layer, factor, constant FROM s) USING (code)),
    g AS (SELECT segment_id, layer, factor, len * CASE WHEN constant THEN greatest(hi - greatest(lo, coalesce(before, 0)), 0) ELSE hi - lo END AS part FROM k)
    SELECT segment_id, layer, round(sum(part), 8) AS length, round(sum(part * factor), 8) AS penalty FROM g GROUP BY segment_id, layer HAVING sum(part) > 1e-9""".replace("PX", "qx").replace("PY", "qy"),
)
def _(t: Tables) -> DataFrame:
    out = G.line_in_polygons(t("segments"), G.layer(t("grid_vertices"), "layer", "factor", "constant"), 4.0, "segment_id").where("length > 1e-9")
    return out.select("segment_id", "layer", F.round("length", 8).alias("length"), F.round("penalty", 8).alias("penalty"))


# --- unions and clips: areas of polygon pairs a, b (code, x0 … y1 and a column grp that both share) in SQL
_PAIRS = f"""wa AS (SELECT code, any_value(grp) AS grp, sum(x0 * y1 - x1 * y0) / 2 AS w, min(x0) AS x, max(x0) AS X1, min(y0) AS y, max(y0) AS Y1 FROM a GROUP BY code), wb AS (SELECT code, any_value(grp) AS grp, sum(x0 * y1 - x1 * y0) / 2 AS w, min(x0) AS x, max(x0) AS X1, min(y0) AS y, max(y0) AS Y1 FROM b GROUP BY code),
    m AS (SELECT wa.code AS l, wb.code AS r, wb.w AS rw FROM wa, wb WHERE wa.grp = wb.grp AND wa.x < wb.X1 AND wb.x < wa.X1 AND wa.y < wb.Y1 AND wb.y < wa.Y1),
    e AS (SELECT l, r, rw, a.x0 AS xa, a.y0 AS ya, a.x1 AS xb, a.y1 AS yb, b.x0 AS xc, b.y0 AS yc, b.x1 AS xd, b.y1 AS yd, greatest(least(a.x0, a.x1), least(b.x0, b.x1)) AS lo, least(greatest(a.x0, a.x1), greatest(b.x0, b.x1)) AS hi FROM m JOIN a ON a.code = l JOIN b ON b.code = r WHERE a.x0 <> a.x1 AND b.x0 <> b.x1),
    s AS (SELECT l, r, any_value(rw) AS rw, sum(sign(xb - xa) * sign(xd - xc) * (hi - lo) * ((u + v) / 2 + CASE WHEN p * q < 0 THEN abs(p * q) / (abs(p) + abs(q)) / 2 ELSE 0 END)) AS area FROM (SELECT *, {_UNDER} FROM e WHERE hi > lo) GROUP BY l, r)"""
# in a layer at most two polygons cover a point, so a union's area is the sum less what pairs share
_DISSOLVED = f"""WITH RECURSIVE a AS (SELECT o.*, layer AS grp FROM ({_OWN}) o JOIN (SELECT DISTINCT code, layer FROM {{vertices}}) USING (code)), b AS (SELECT * FROM a), {_PAIRS},
    k AS (SELECT l, r, area FROM s WHERE l <> r AND area > 1e-9), c AS (SELECT code AS id, code AS top FROM wa UNION SELECT k.l, c.top FROM k JOIN c ON k.r = c.id),
    t AS (SELECT id, min(top) AS component FROM c GROUP BY id)
    SELECT component, count(*) AS n, round(sum(w), 7) AS summed, round(sum(w) - coalesce(any_value(shared), 0), 7) AS dissolved FROM t JOIN wa ON id = code LEFT JOIN (SELECT component, sum(area) / 2 AS shared FROM k JOIN t ON id = l GROUP BY component) USING (component) GROUP BY component"""


@query("geo10_true_dissolve", _DISSOLVED)
def _(t: Tables) -> DataFrame:
    own = materialize(G.layer(t("vertices"), "layer"), "layer")
    out = G.dissolve_summary(own, *G.dissolve_polygons(own, 6.0, "layer"), 6.0)
    return out.select("component", "n", F.round("summed", 7).alias("summed"), F.round("dissolved", 7).alias("dissolved"))


@query("geo10_rings", f"SELECT component, dissolved AS area FROM ({_DISSOLVED})")
def _(t: Tables) -> DataFrame:
    own = materialize(G.layer(t("vertices"), "layer"), "layer")
    at = G.rings(G.dissolve_polygons(own, 6.0, "layer")[1], "component")
    w = W.partitionBy("component", "ring").orderBy("seq")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nxt = lambda v: F.coalesce(F.lead(v).over(w), F.first(v).over(whole))
    return at.withColumn("a", F.col("x") * nxt("y") - nxt("x") * F.col("y")).groupBy("component").agg(F.round(F.sum("a") / 2, 7).alias("area"))


@query(
    "geo11_true_clip",
    f"""WITH a AS (SELECT *, 0 AS grp FROM ({_OWN}) WHERE code LIKE 'Z%'), b AS (SELECT *, 0 AS grp FROM ({_BOXES})), {_PAIRS} SELECT r AS code, round(any_value(rw), 7) AS source, round(sum(area), 7) AS clipped FROM s GROUP BY r HAVING sum(area) > 1e-9""",
)
def _(t: Tables) -> DataFrame:
    boxes = t("boxes")
    again = boxes.unionByName(boxes.where("CAST(code AS INT) % 3 = 0"))  # as tiles that overlap are read
    return G.clip_features(again, t("vertices").where("code like 'Z%'"), 6.0)[0].where("clipped > 1e-9").select("code", F.round("source", 7).alias("source"), F.round("clipped", 7).alias("clipped"))


_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query(
    "sto3_union_coverage",
    """WITH f AS (SELECT c.region, layer, greatest(f.xmin, c.x0) AS a, least(f.xmax, c.x1) AS b, greatest(f.ymin, c.y0) AS d, least(f.ymax, c.y1) AS e FROM (SELECT * FROM {features}) f JOIN (SELECT * FROM {cells}) c ON f.xmin < c.x1 AND f.xmax > c.x0 AND f.ymin < c.y1 AND f.ymax > c.y0),
    xs AS (SELECT region, layer, v AS lo, lead(v) OVER (PARTITION BY region, layer ORDER BY v) AS hi FROM (SELECT region, layer, a AS v FROM f UNION SELECT region, layer, b FROM f)), ys AS (SELECT region, layer, v AS lo, lead(v) OVER (PARTITION BY region, layer ORDER BY v) AS hi FROM (SELECT region, layer, d AS v FROM f UNION SELECT region, layer, e FROM f)),
    u AS (SELECT xs.region, xs.layer, sum((xs.hi - xs.lo) * (ys.hi - ys.lo)) / 25 AS share FROM xs JOIN ys ON xs.region = ys.region AND xs.layer = ys.layer WHERE EXISTS (SELECT 1 FROM f WHERE f.region = xs.region AND f.layer = xs.layer AND f.a <= xs.lo AND f.b >= xs.hi AND f.d <= ys.lo AND f.e >= ys.hi) GROUP BY 1, 2)
    SELECT region, """
    + ", ".join(f"round(coalesce(sum(share) FILTER (layer = '{s}'), 0), 7) AS {s.lower()}" for s in _TYPES)
    + " FROM (SELECT region FROM {cells}) LEFT JOIN u USING (region) GROUP BY region",
)
def _(t: Tables) -> DataFrame:
    source = t("features").select(F.col("feature_id").cast("string").alias("code"), F.col("layer").alias("source"))
    boxes = G.layer(t("boxes")).join(source, "code")
    corner = F.explode(F.array(*(F.struct(F.lit(k).alias("seq"), F.col(x).alias("x"), F.col(y).alias("y")) for k, (x, y) in enumerate((("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))))))
    cells = t("cells").select(F.col("region").alias("code"), F.lit(0).alias("part"), F.lit(0).alias("ring"), corner.alias("v")).select("code", "part", "ring", "v.*")
    out = G.union_coverage(G.layer(cells), boxes, 3.0, _TYPES)
    return out.select(F.col("code").alias("region"), *(F.round(s, 7).alias(s.lower()) for s in _TYPES))


#: The polygons with some rings that can't be used: sides that cross, a missing coordinate, and one that repeats another.
ADAPTERS["surveyed"] = """
    SELECT code, part, ring, seq, x, y FROM {vertices} UNION ALL
    SELECT concat('S', CAST(n_nationkey AS STRING)), 0, 0, seq, -140.3e0 + n_nationkey * 2.7e0 + dx, CASE WHEN n_nationkey % 4 = 1 AND seq = 2 THEN NULL ELSE 50.1e0 + dy END FROM {nation} CROSS JOIN (VALUES (0, 0e0, 0e0), (1, 2e0, 2.2e0), (2, 2e0, 0e0), (3, 0e0, 2e0)) AS v(seq, dx, dy) WHERE n_nationkey % 4 < 3 UNION ALL
    SELECT concat('T', CAST(n_nationkey AS STRING)), 0, 0, seq, -140.3e0 + n_nationkey * 2.7e0 + dx, 50.1e0 + dy FROM {nation} CROSS JOIN (VALUES (0, 0e0, 0e0), (1, 2e0, 2.2e0), (2, 2e0, 0e0), (3, 0e0, 2e0)) AS v(seq, dx, dy) WHERE n_nationkey % 4 = 0"""
_RAW = """SELECT code, part, ring, seq, x AS x0, y AS y0, x1, y1 FROM (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1 FROM (
    SELECT *, lag(x) OVER (PARTITION BY code, part, ring ORDER BY seq) AS px, lag(y) OVER (PARTITION BY code, part, ring ORDER BY seq) AS py FROM {surveyed} WHERE x IS NOT NULL AND y IS NOT NULL) WHERE px IS NULL OR px <> x OR py <> y WINDOW w AS (PARTITION BY code, part, ring ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE x <> x1 OR y <> y1"""


def _left(a: str, b: str, v: str) -> str:
    return f"sign(({a}.x1 - {a}.x0) * ({b}.y{v} - {a}.y0) - ({b}.x{v} - {a}.x0) * ({a}.y1 - {a}.y0))"


_FAULTS = f"""WITH s AS ({_RAW}), n AS (SELECT code, part, ring, bool_or(x IS NULL OR y IS NULL) AS gone FROM {{surveyed}} GROUP BY 1, 2, 3), k AS (SELECT code, part, ring, count(*) AS n, abs(sum(x0 * y1 - x1 * y0) / 2) AS area FROM s GROUP BY 1, 2, 3),
    c AS (SELECT DISTINCT a.code, a.part, a.ring FROM s a JOIN s b ON a.code = b.code AND a.part = b.part AND a.ring = b.ring AND a.seq < b.seq WHERE {_left('a', 'b', '0')} * {_left('a', 'b', '1')} < 0 AND {_left('b', 'a', '0')} * {_left('b', 'a', '1')} < 0),
    f AS (SELECT n.code, n.part, n.ring, CASE WHEN gone THEN 'null' WHEN coalesce(n, 0) < 3 THEN 'short' WHEN c.code IS NOT NULL THEN 'crossing' WHEN area <= 1e-12 THEN 'no_area' END AS reason FROM n LEFT JOIN k USING (code, part, ring) LEFT JOIN c USING (code, part, ring))"""


@query("geo9_ring_faults", f"{_FAULTS} SELECT * FROM f WHERE reason IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return G.ring_faults(t("surveyed"), 3.0)


@query(
    "grf12_ring_quality",
    f"{_FAULTS} SELECT count(*) AS n, count(*) FILTER (reason = 'null') AS n_null, count(*) FILTER (reason IN ('short', 'no_area')) AS n_empty, count(*) FILTER (reason = 'crossing') AS n_invalid, count(*) - (SELECT count(DISTINCT p) FROM (SELECT list((x, y) ORDER BY seq) AS p FROM {{surveyed}} GROUP BY code, part, ring)) AS n_repeated FROM f",
)
def _(t: Tables) -> DataFrame:
    return G.geometry_quality(t("surveyed"), 3.0)


@query(
    "geo14_exposure",
    """SELECT code, centre, round(a, 7) AS area, round(a / own, 10) AS share, band, CASE band WHEN 'low' THEN 1e0 WHEN 'mid' THEN 1.5e0 ELSE 2.25e0 END AS factor FROM (SELECT *, CASE WHEN value < 1000 THEN 'low' WHEN value <= 1500 THEN 'mid' ELSE 'high' END AS band FROM (
      SELECT code, feature_id AS centre, value, (z.xmax - z.xmin) * (z.ymax - z.ymin) AS own, greatest(least(z.xmax, f.xmax) - greatest(z.xmin, f.xmin), 0) * greatest(least(z.ymax, f.ymax) - greatest(z.ymin, f.ymin), 0) AS a FROM (SELECT * FROM {zones}) z JOIN (SELECT * FROM {features}) f ON z.grp = f.feature_id % 5)) WHERE a > 1e-9""",
)
def _(t: Tables) -> DataFrame:
    bands = t.sql("SELECT DISTINCT 'low' AS band, CAST(NULL AS DOUBLE) AS lower, 1e3 AS upper, true AS lower_inclusive, false AS upper_inclusive, 1e0 AS factor FROM {region} UNION ALL SELECT DISTINCT 'mid', 1e3, 1.5e3, true, true, 1.5e0 FROM {region} UNION ALL SELECT DISTINCT 'high', 1.5e3, CAST(NULL AS DOUBLE), false, true, 2.25e0 FROM {region}")
    corner = F.explode(F.array(*(F.struct(F.lit(k).alias("seq"), F.col(x).alias("x"), F.col(y).alias("y")) for k, (x, y) in enumerate((("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"))))))
    zones = t("zones").select("code", F.lit(0).alias("part"), F.lit(0).alias("ring"), corner.alias("v"), "grp").select("code", "part", "ring", "v.*", F.col("grp").alias("jurisdiction"))
    of = t("features").select(F.col("feature_id").cast("string").alias("code"), F.col("feature_id").alias("centre"), (F.col("feature_id") % 5).cast("int").alias("jurisdiction"), "value")
    centres = G.layer(t("boxes")).join(of, "code").drop("code")
    out = G.population_exposure(G.layer(zones, "jurisdiction"), centres, bands, 8.0, "value").where("area > 1e-9")
    return out.select("code", "centre", F.round("area", 7).alias("area"), F.round("share", 10).alias("share"), "band", "factor")
