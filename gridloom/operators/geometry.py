"""Grids, projection, rectangles, segments and spatial joins (GEO-*)."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# fixed values: the Canadian Lambert conformal conic (EPSG:3347) on the GRS 80 ellipsoid
A, INV_F = 6378137.0, 298.257222101
LAT_0, LON_0, LAT_1, LAT_2, X_0, Y_0 = 63.390675, -91.866666666666667, 49.0, 77.0, 6200000.0, 3000000.0

_E = math.sqrt(2 / INV_F - 1 / INV_F**2)


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - (_E * math.sin(phi)) ** 2)


def _t(phi: float) -> float:
    return math.tan(math.pi / 4 - phi / 2) / ((1 - _E * math.sin(phi)) / (1 + _E * math.sin(phi))) ** (_E / 2)


_P1, _P2, _P0 = (math.radians(v) for v in (LAT_1, LAT_2, LAT_0))
N = (math.log(_m(_P1)) - math.log(_m(_P2))) / (math.log(_t(_P1)) - math.log(_t(_P2)))
FF = _m(_P1) / (N * _t(_P1) ** N)
RHO_0 = A * FF * _t(_P0) ** N


def project(lon: Column, lat: Column) -> tuple[Column, Column]:
    """GEO-7: easting and northing in metres."""
    phi = F.radians(lat)
    s = _E * F.sin(phi)
    t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(_E / 2))
    rho, theta = A * FF * F.pow(t, F.lit(N)), N * F.radians(lon - LON_0)
    return X_0 + rho * F.sin(theta), Y_0 + RHO_0 - rho * F.cos(theta)


def unproject(x: Column, y: Column) -> tuple[Column, Column]:
    """GEO-7: longitude and latitude, by five fixed steps."""
    dx, dy = x - X_0, RHO_0 - (y - Y_0)
    t = F.pow(F.sqrt(dx * dx + dy * dy) / (A * FF), F.lit(1 / N))
    phi = math.pi / 2 - 2 * F.atan(t)
    for _ in range(5):
        s = _E * F.sin(phi)
        phi = math.pi / 2 - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(_E / 2)))
    return F.degrees(F.atan2(dx, dy) / N) + LON_0, F.degrees(phi)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """GEO-8: kilometres on a sphere."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


@F.pandas_udf(DoubleType())
def geodesic_km(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    """GEO-8: kilometres on the ellipsoid, by the inverse series of Vincenty; null for (nearly) opposite points, where it does not settle."""
    import numpy as np

    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(v.to_numpy(float)))) for v in (lat1, lat2))
    long_ = np.radians(lon2.to_numpy(float) - lon1.to_numpy(float))
    lam, settled = long_.copy(), np.zeros(len(long_), bool)
    with np.errstate(all="ignore"):
        for _ in range(60):
            ss = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
            cs = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / np.where(ss == 0, 1, ss))
            ca2 = 1 - sa**2
            c2m = np.where(ca2 == 0, 0, cs - 2 * np.sin(u1) * np.sin(u2) / np.where(ca2 == 0, 1, ca2))
            c = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
            new = long_ + (1 - c) * f * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
            settled = np.abs(new - lam) < 1e-12
            lam = new
            if settled.all():
                break
        us = ca2 * (a**2 - b**2) / b**2
        big_a = 1 + us / 16384 * (4096 + us * (us * (320 - 175 * us) - 768))
        big_b = us / 1024 * (256 + us * (us * (74 - 47 * us) - 128))
        ds = big_b * ss * (c2m + big_b / 4 * (cs * (2 * c2m**2 - 1) - big_b / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
        out = b * big_a * (sigma - ds) / 1000
    return pd.Series(np.where(settled, out, np.nan))


def aligned_bounds(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """GEO-1: one row: the bounds of the points, floored and ceiled to the cell size."""
    return df.agg(*((op(f(c) / size) * size).cast("double").alias(n) for c, f, op, n in ((x, F.min, F.floor, "xmin"), (y, F.min, F.floor, "ymin"), (x, F.max, F.ceil, "xmax"), (y, F.max, F.ceil, "ymax"))))


def candidate_grid(bounds: DataFrame, size: float, digits: int = 6) -> DataFrame:
    """GEO-2: all cells of the bounds: ix, iy, corners and centre. Corners come from whole indices, so they do not drift."""
    span = lambda lo, hi: F.explode(F.sequence(F.lit(0), F.greatest(F.round((F.col(hi) - F.col(lo)) / size).cast("int") - 1, F.lit(0))))
    cells = bounds.withColumn("ix", span("xmin", "xmax")).withColumn("iy", span("ymin", "ymax"))
    at = lambda lo, i, d: F.round(F.col(lo) + (F.col(i) + d) * size, digits)
    return cells.select(
        "ix", "iy", at("xmin", "ix", 0).alias("x0"), at("ymin", "iy", 0).alias("y0"), at("xmin", "ix", 1).alias("x1"), at("ymin", "iy", 1).alias("y1"), at("xmin", "ix", 0.5).alias("cx"), at("ymin", "iy", 0.5).alias("cy")
    )


def in_rectangle(x: Column, y: Column, border: str = "include") -> Column:
    """Whether a point lies in the rectangle xmin..ymax of its row, the border in or out."""
    c = F.col
    if border == "include":
        return x.between(c("xmin"), c("xmax")) & y.between(c("ymin"), c("ymax"))
    return (x > c("xmin")) & (x < c("xmax")) & (y > c("ymin")) & (y < c("ymax"))


def tiles(size: float, xmin: str = "xmin", ymin: str = "ymin", xmax: str = "xmax", ymax: str = "ymax") -> Column:
    """Keys of the square tiles a rectangle touches, to join on before any exact test."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))
    return F.flatten(F.transform(span(xmin, xmax), lambda i: F.transform(span(ymin, ymax), lambda j: F.struct(i.alias("tx"), j.alias("ty")))))


def tile_of(x: Column, y: Column, size: float) -> Column:
    return F.struct(F.floor(x / size).alias("tx"), F.floor(y / size).alias("ty"))


def met_here(tile: float, *low: tuple[str, str]) -> Column:
    """Whether the tile of a joined row (column _tile) holds the low corner of what two rectangles share, so that each pair of them counts in one of their tiles.

    low: for x and y the columns of the two low bounds.
    """
    x, y = (F.floor(F.greatest(*own) / tile) for own in low)
    return (F.col("_tile.tx") == x) & (F.col("_tile.ty") == y)


def points_in_rectangles(points: DataFrame, rects: DataFrame, tile: float, x: str = "x", y: str = "y", key: str = "point_id", code: str = "code", border: str = "include") -> DataFrame:
    """GEO-J1: points with the rectangle that holds them; of several the lexically least code. Points outside all are left out."""
    p = points.withColumn("_tile", tile_of(F.col(x), F.col(y), tile))
    r = rects.withColumn("_tile", F.explode(tiles(tile)))
    hit = p.join(r, "_tile").where(in_rectangle(F.col(x), F.col(y), border)).drop("_tile")
    return hit.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(code))).where("_n = 1").drop("_n")


def rectangle_distance(x: Column, y: Column) -> Column:
    """From a point to the rectangle of its row; 0 inside."""
    c = F.col
    dx = F.greatest(c("xmin") - x, F.lit(0.0), x - c("xmax"))
    dy = F.greatest(c("ymin") - y, F.lit(0.0), y - c("ymax"))
    return F.sqrt(dx * dx + dy * dy)


def within_or_nearest(points: DataFrame, rects: DataFrame, limit: float, x: str = "x", y: str = "y", key: str = "point_id", code: str = "code", border: str = "include", same: str | None = None) -> DataFrame:
    """GEO-J2, GEO-J5: the holding rectangle, else the nearest within the limit (ties by code), else none: adds code, distance, matched_by (within, nearest, none).

    same: a column that both sides must share. Only tiles of the limit's size next to a point are looked at.
    """
    base = points.drop(*[c for c in ("code", "distance", "matched_by") if c in points.columns])
    wide = rects.select(F.col(code).alias("code"), "xmin", "ymin", "xmax", "ymax", *([F.col(same).alias("_same")] if same else []))
    p = base.withColumn("_tile", tile_of(F.col(x), F.col(y), limit))
    r = wide.withColumns({"_a": F.col("xmin") - limit, "_b": F.col("ymin") - limit, "_c": F.col("xmax") + limit, "_d": F.col("ymax") + limit}).withColumn("_tile", F.explode(tiles(limit, "_a", "_b", "_c", "_d")))
    near = p.join(r, "_tile").withColumn("distance", rectangle_distance(F.col(x), F.col(y))).where(F.col("distance") <= limit)
    if same:
        near = near.where(F.col(same) == F.col("_same"))
    inside = in_rectangle(F.col(x), F.col(y), border)
    best = near.groupBy(key).agg(F.min(F.struct((~inside).alias("outside"), "distance", "code")).alias("best"))
    out = base.join(best, key, "left")
    how = F.when(F.col("best").isNull(), "none").when(F.col("best.outside"), "nearest").otherwise("within")
    return out.select(*base.columns, F.col("best.code").alias("code"), F.col("best.distance").alias("distance"), how.alias("matched_by"))


def snap_limit(factor: float, resolution: Column, unit: Column) -> Column:
    """GEO-J3: metres within which a point may snap: factor cells of degrees or kilometres."""
    return factor * resolution * F.when(unit == "degrees", 111_000.0).otherwise(1_000.0)


def nearest_in_group(points: DataFrame, hubs: DataFrame, group: str, key: str, hub: str, most_rounds: int = 64) -> DataFrame:
    """GEO-J4: each point's nearest hub of its group (ties by hub id), with the distance. Points of a group without hubs are left out.

    A point looks at the nine tiles around it; tiles of a group hold about one hub. A hub found within a tile's width is proven the nearest, other points go on with tiles
    twice as wide, so no group is joined with itself. Points of one place are looked up once, and of hubs in one place the least id stands for all. A round writes what it
    proved and what goes on as one table in the shared folder.
    """
    from gridloom.session import drop_folder, materialize

    place = [F.col(group).alias("_g"), F.col("x").alias("_px"), F.col("y").alias("_py")]
    h = hubs.where("x is not null and y is not null").groupBy(F.col(group).alias("_g"), F.col("x").alias("_x"), F.col("y").alias("_y")).agg(F.min(hub).alias("_hub"))
    h = materialize(h, "hubs")
    wide, high = F.max("_x") - F.min("_x"), F.max("_y") - F.min("_y")
    size = F.greatest(F.sqrt(wide * high / F.count("*")), F.greatest(wide, high) / F.count("*"))
    sizes = h.groupBy("_g").agg(F.when(size > 0, size).otherwise(1.0).alias("_size"))
    left = points.where("x is not null and y is not null").select(*place).distinct().join(sizes, "_g")
    h = h.join(sizes, "_g")
    found, kept = [], None
    for k in range(most_rounds):
        width = F.col("_size") * float(2**k)
        at = lambda x, y: (F.floor(F.col(x) / width).alias("_tx"), F.floor(F.col(y) / width).alias("_ty"))  # noqa: B023, E731
        near = left.select("*", *at("_px", "_py")).withColumn("_d", F.explode(F.array(*(F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)))))
        near = near.withColumns({"_tx": F.col("_tx") + F.col("_d.x"), "_ty": F.col("_ty") + F.col("_d.y")}).drop("_d")
        met = near.join(h.select("_g", "_hub", "_x", "_y", *at("_x", "_y")), ["_g", "_tx", "_ty"], "left")
        d = F.sqrt(F.pow(F.col("_px") - F.col("_x"), 2) + F.pow(F.col("_py") - F.col("_y"), 2))
        best = met.groupBy("_g", "_px", "_py", "_size").agg(F.min(F.when(F.col("_hub").isNotNull(), F.struct(d.alias("distance"), F.col("_hub").alias("hub")))).alias("b"))
        looked = materialize(best.withColumn("_near", F.coalesce(F.col("b.distance") <= width, F.lit(False))), "nearest")
        if kept is not None and not proven:
            drop_folder(kept)
        proven = not looked.where("_near").isEmpty()
        if proven:
            found.append(looked.where("_near").select("_g", "_px", "_py", "b"))
        left, kept = looked.where("not _near").drop("b", "_near"), looked
        if left.isEmpty():
            break
    else:
        raise RuntimeError("hubs lie too far from points")
    out = found[0] if found else looked.select("_g", "_px", "_py", "b")
    for f in found[1:]:
        out = out.unionByName(f)
    own = points.select(F.col(key), *place)
    return own.join(out, ["_g", "_px", "_py"]).select(key, F.col("b.hub").alias(hub), F.col("b.distance").alias("distance"))


def overlay(left: DataFrame, right: DataFrame, tile: float, left_id: str, right_id: str) -> DataFrame:
    """GEO-J6: positive-area intersections of two layers of rectangles with their share of either, in [0, 1]."""
    side = lambda df, i, s: df.select(F.col(i).alias(f"{s}_id"), *(F.col(c).alias(f"{s}_{c}") for c in ("xmin", "ymin", "xmax", "ymax")), F.explode(tiles(tile)).alias("_tile"))
    both = side(left, left_id, "l").join(side(right, right_id, "r"), "_tile").where(met_here(tile, ("l_xmin", "r_xmin"), ("l_ymin", "r_ymin"))).drop("_tile")
    edge = lambda a, b: F.greatest(F.least(f"l_{b}", f"r_{b}") - F.greatest(f"l_{a}", f"r_{a}"), F.lit(0.0))
    own = lambda s: (F.col(f"{s}_xmax") - F.col(f"{s}_xmin")) * (F.col(f"{s}_ymax") - F.col(f"{s}_ymin"))
    area = edge("xmin", "xmax") * edge("ymin", "ymax")
    share = lambda s: F.least(F.greatest(area / own(s), F.lit(0.0)), F.lit(1.0))
    return both.select(F.col("l_id").alias(left_id), F.col("r_id").alias(right_id), area.alias("area"), share("l").alias("left_share"), share("r").alias("right_share")).where("area > 0")


def clip_interval() -> tuple[Column, Column]:
    """Liang and Barsky: the part (from, to) of the segment x0,y0-x1,y1 of a row in its rectangle, as fractions; from > to: none."""
    c = F.col
    lo, hi = F.lit(0.0), F.lit(1.0)
    for p, q in ((c("x0") - c("x1"), c("x0") - c("xmin")), (c("x1") - c("x0"), c("xmax") - c("x0")), (c("y0") - c("y1"), c("y0") - c("ymin")), (c("y1") - c("y0"), c("ymax") - c("y0"))):
        t = F.try_divide(q, p)
        lo = F.greatest(lo, F.when(p < 0, t).when((p == 0) & (q < 0), 2.0).otherwise(0.0))
        hi = F.least(hi, F.when(p > 0, t).when((p == 0) & (q < 0), -1.0).otherwise(1.0))
    return lo, hi


def line_in_layers(edges: DataFrame, layers: DataFrame, tile: float, key: str = "edge_id") -> DataFrame:
    """GEO-J7: length of each edge (x0, y0, x1, y1) in each layer times its factor.

    layers: layer, factor, constant (boolean), xmin..ymax. Rectangles of a constant-factor layer count once where they overlap (their intervals are merged); those of a
    column-factor layer add up, equal ones included.
    """
    e = edges.withColumns({"_a": F.least("x0", "x1"), "_b": F.least("y0", "y1"), "_c": F.greatest("x0", "x1"), "_d": F.greatest("y0", "y1")}).withColumn("_tile", F.explode(tiles(tile, "_a", "_b", "_c", "_d")))
    r = layers.withColumn("_tile", F.explode(tiles(tile)))
    lo, hi = clip_interval()
    length = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    hit = e.join(r, "_tile").where(met_here(tile, ("_a", "xmin"), ("_b", "ymin"))).withColumns({"lo": lo, "hi": hi, "len": length}).where("hi > lo")
    w = W.partitionBy(key, "layer").orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(F.col("constant"), F.greatest(F.col("hi") - F.greatest("lo", F.coalesce(before, F.lit(0.0))), F.lit(0.0))).otherwise(F.col("hi") - F.col("lo"))
    return hit.withColumn("part", new * F.col("len")).groupBy(key, "layer").agg(F.sum("part").alias("length"), F.sum(F.col("part") * F.col("factor")).alias("penalty"))


def segment_cells(segments: DataFrame, size: float, key: str) -> DataFrame:
    """GEO-J8: all grid cells (ix, iy) of a size that a segment touches, be it at a corner (to a billionth of the segment)."""
    s = segments.withColumns({"_a": F.least("x0", "x1"), "_b": F.least("y0", "y1"), "_c": F.greatest("x0", "x1"), "_d": F.greatest("y0", "y1")})
    s = s.withColumn("t", F.explode(tiles(size, "_a", "_b", "_c", "_d"))).withColumns({"xmin": F.col("t.tx") * size, "ymin": F.col("t.ty") * size, "xmax": (F.col("t.tx") + 1) * size, "ymax": (F.col("t.ty") + 1) * size})
    lo, hi = clip_interval()
    return s.where(lo <= hi + 1e-9).select(key, F.col("t.tx").alias("ix"), F.col("t.ty").alias("iy"))


def dense_regions(cells: DataFrame) -> DataFrame:
    """GEO-4: cells numbered R0, R1, … by centre row, then column: a range sort with counts per partition, so no partition holds all."""
    spark = cells.sparkSession
    ordered = cells.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "cy", "cx").sortWithinPartitions("cy", "cx").withColumn("_p", F.spark_partition_id())
    counts = ordered.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a partition
    n = F.row_number().over(W.partitionBy("_p").orderBy("cy", "cx")) - 1
    return ordered.join(F.broadcast(before), "_p").withColumn("region", F.concat(F.lit("R"), (F.col("_before") + n).cast("long").cast("string"))).drop("_p", "_before")


def region_metadata(regions: DataFrame, resolution: float, unit: str, crs: str, to_lonlat: Callable[[Column, Column], tuple[Column, Column]] | None = None) -> DataFrame:
    """GEO-4: numbered cells with what names their place: lon and lat of the centre, resolution and its unit, the system, and the centre as `site`.

    to_lonlat: from centre to degrees, as unproject(); without it centres are degrees already.
    """
    lon, lat = to_lonlat(F.col("cx"), F.col("cy")) if to_lonlat else (F.col("cx"), F.col("cy"))
    site = F.concat(F.format_number(lat, 4), F.lit(","), F.format_number(lon, 4))
    return regions.withColumns({"lon": lon, "lat": lat, "resolution": F.lit(float(resolution)), "resolution_unit": F.lit(unit), "crs": F.lit(crs), "site": site})


def grid_summary(cells: DataFrame, *keys: str) -> DataFrame:
    """GEO-5: rows and extents per variant."""
    return cells.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x0").alias("xmin"), F.min("y0").alias("ymin"), F.max("x1").alias("xmax"), F.max("y1").alias("ymax"))


def evidence_summary(features: DataFrame, keys: list[str], source: str, clipped: str) -> DataFrame:
    """GEO-12: features and measures per class; null groups stay."""
    return features.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(source).alias("source"), F.sum(clipped).alias("clipped"))


def select_boundaries(rects: DataFrame, wanted: list[str], code: str = "code") -> DataFrame:
    """GEO-6: the parts of the wanted jurisdictions; a missing one is an error. Parts are disjoint, so together they are the union."""
    from gridloom.operators.joins import ContractError

    found = {r[0] for r in rects.where(F.col(code).isin(wanted)).select(code).distinct().collect()}  # at most the wanted ones
    if missing := sorted(set(wanted) - found):
        raise ContractError(f"no boundary for {missing}")
    return rects.where(F.col(code).isin(wanted))


def union_area(rects: pd.DataFrame) -> float:
    """Area under rectangles, each point once: strips between all x bounds, merged intervals of y in each."""
    xs, area = sorted({*rects["xmin"], *rects["xmax"]}), 0.0
    for a, b in zip(xs[:-1], xs[1:], strict=True):
        own = rects[(rects["xmin"] <= a) & (rects["xmax"] >= b)].sort_values("ymin")
        end, covered = -math.inf, 0.0
        for lo, hi in zip(own["ymin"], own["ymax"], strict=True):
            covered += max(0.0, hi - max(lo, end))
            end = max(end, hi)
        area += covered * (b - a)
    return area


def dissolve(rects: DataFrame, tile: float, key: str) -> DataFrame:
    """GEO-10: rectangles joined by overlaps of positive area, transitively: component (least key), parts, summed and dissolved area. Touching only is no overlap. Keys are whole numbers.

    Rectangles of one low corner overlap each other, and one that lies within another of its corner meets nothing that the other doesn't. So corners are what is linked,
    through the outer rectangles of each, and copies or nested ones make no pairs.
    """
    from gridloom.operators.components import connected_components
    from gridloom.session import materialize

    own = rects.select(F.col(key).cast("long").alias("a"), "xmin", "ymin", "xmax", "ymax")
    solid = own.where("xmax > xmin and ymax > ymin")
    corners = solid.groupBy("xmin", "ymin").agg(F.min("a").alias("corner"))
    wider = W.partitionBy("xmin", "ymin").orderBy(F.desc("xmax")).rowsBetween(W.unboundedPreceding, -1)
    tall = solid.groupBy("xmin", "ymin", "xmax").agg(F.max("ymax").alias("ymax")).withColumn("_m", F.max("ymax").over(wider))
    outer = materialize(tall.where("_m is null or ymax > _m").join(corners, ["xmin", "ymin"]).select("corner", "xmin", "ymin", "xmax", "ymax"), "outer")
    links = overlay(outer, outer.withColumnRenamed("corner", "b"), tile, "corner", "b").where("corner < b").select("corner", "b")
    member = connected_components(links, "corner", "b").withColumnRenamed("node", "corner")
    found = outer.join(member, "corner", "left").withColumn("component", F.coalesce("component", "corner"))
    of = found.select("xmin", "ymin", "component").distinct()
    placed = solid.join(of, ["xmin", "ymin"]).unionByName(own.where("not coalesce(xmax > xmin and ymax > ymin, false)").withColumn("component", F.col("a")))
    area = F.sum((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))).alias("summed")
    sums = placed.groupBy("component").agg(F.count("*").alias("n"), area)
    several = found.join(sums.where("n > 1").select("component"), "component", "left_semi").withColumn("_t", F.explode(tiles(tile)))
    # areas add up over tiles, so a group is what one tile holds of a component
    cut = several.select(
        "component", "_t.tx", "_t.ty", F.greatest("xmin", F.col("_t.tx") * tile).alias("xmin"), F.greatest("ymin", F.col("_t.ty") * tile).alias("ymin"), F.least("xmax", (F.col("_t.tx") + 1) * tile).alias("xmax"), F.least("ymax", (F.col("_t.ty") + 1) * tile).alias("ymax")
    ).where("xmax > xmin and ymax > ymin")
    by_tile = cut.groupBy("component", "tx", "ty").applyInPandas(lambda g: pd.DataFrame({"component": [g["component"].iloc[0]], "part": [union_area(g)]}), "component long, part double")
    dissolved = by_tile.groupBy("component").agg(F.sum("part").alias("dissolved"))
    return sums.join(dissolved, "component", "left").withColumn("dissolved", F.coalesce("dissolved", "summed"))


def clip_tiles(features: DataFrame, areas: DataFrame, tile: float, key: str) -> DataFrame:
    """GEO-11: features read by tile, each once, cut to the study area (disjoint rectangles): source and clipped area."""
    source = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    once = features.dropDuplicates([key])
    parts = overlay(once, areas.withColumn("_area", F.lit(0)), tile, key, "_area").groupBy(key).agg(F.sum("area").alias("clipped"))
    return once.join(parts, key).select(key, source.alias("source"), "clipped")
