"""Polygons with any rings (GEO-9, and the polygon forms of GEO-3, GEO-10, GEO-11, GEO-14, GEO-J1, GEO-J2, GEO-J6, GEO-J7, GEO-J9, STO-3, GRF-12), with DataFrame functions.

A layer is a table of vertices (code, part, ring, seq, x, y): ring 0 of a part is its outer border, further ones are holes. `layer` turns it into directed sides with the
inside to their left (outer rings turn left, holes right), a row a side; all that follows works on sides dealt to tiles (`planar`), so no row or task holds a polygon.
Rings that can't be used are reported by `ring_faults`. Only `rings`, which puts a border's vertices in order, takes one ring at a time into a task.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators import planar as P
from gridloom.operators.planar import XY
from gridloom.session import materialize

RING = ("code", "part", "ring")


def sides(vertices: DataFrame) -> DataFrame:
    """Directed sides of each ring, closed; points that repeat the one before are left out."""
    w = W.partitionBy(*RING).orderBy("seq")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    at = vertices.where("x is not null and y is not null").withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w)}).where("px is null or px <> x or py <> y").drop("px", "py")
    at = at.withColumns({"x1": F.coalesce(F.lead("x").over(w), F.first("x").over(whole)), "y1": F.coalesce(F.lead("y").over(w), F.first("y").over(whole))})
    return at.where("x <> x1 or y <> y1").select(*RING, "seq", F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1")


def normalised(vertices: DataFrame) -> DataFrame:
    """GEO-9: rings closed, without repeated points, of at least three sides and some area, outer ones turning left and holes right: sides with `turned` (the ring was reversed) and `area` (of the ring, positive)."""
    own = sides(vertices)
    sums = own.groupBy(*RING).agg(F.count("*").alias("n"), (F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2).alias("signed"))
    good = sums.where((F.col("n") >= 3) & (F.abs("signed") > 1e-12)).select(*RING, "signed", ((F.col("signed") < 0) == (F.col("ring") == 0)).alias("turned"))
    pick = lambda a, b: F.when(F.col("turned"), F.col(b)).otherwise(F.col(a))
    return own.join(good, list(RING)).select(*RING, "seq", pick("x0", "x1").alias("x0"), pick("y0", "y1").alias("y0"), pick("x1", "x0").alias("x1"), pick("y1", "y0").alias("y1"), "turned", F.abs("signed").alias("area"))


def ring_faults(vertices: DataFrame, tile: float) -> DataFrame:
    """GEO-9, GRF-12: rings that are not as they should be, with the reason: null (a coordinate is missing), short (fewer than three sides), crossing (two of its sides cross or lie on each other), no_area."""
    own = sides(vertices)
    every = vertices.groupBy(*RING).agg(F.max((F.col("x").isNull() | F.col("y").isNull()).cast("int")).alias("null"))
    sums = own.groupBy(*RING).agg(F.count("*").alias("n"), F.abs(F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2).alias("area"))
    keyed = materialize(own.select(*RING, *XY, F.col("seq").alias("_side")), "sides")
    crossed = P.cut(keyed, keyed, tile, RING, but="_side").groupBy(*RING, "_side").agg(F.count("*").alias("k")).where("k > 1").select(*RING).distinct().withColumn("crossing", F.lit(True))
    all_ = every.join(sums, list(RING), "left").join(crossed, list(RING), "left")
    reason = F.when(F.col("null") == 1, "null").when(F.coalesce("n", F.lit(0)) < 3, "short").when(F.col("crossing"), "crossing").when(F.col("area") <= 1e-12, "no_area")
    return all_.select(*RING, reason.alias("reason")).where("reason is not null")


def geometry_quality(vertices: DataFrame, tile: float) -> DataFrame:
    """GRF-12: one row: rings, those with a missing coordinate, empty ones (short or without area), invalid ones (sides that cross) and repeats (the same points in the same order as another ring)."""
    n = vertices.select(*RING).distinct().count()
    shape = vertices.groupBy(*RING).agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("p")).select(F.sha2(F.transform("p", lambda v: F.struct(v["x"], v["y"])).cast("string"), 256).alias("h"))
    faults = ring_faults(vertices, tile)
    of = lambda *names: F.count_if(F.col("reason").isin(*names))
    counts = faults.agg(of("null").alias("n_null"), of("short", "no_area").alias("n_empty"), of("crossing").alias("n_invalid"))
    repeats = shape.groupBy("h").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n_repeated"))
    return counts.join(repeats).select(F.lit(n).cast("long").alias("n"), "n_null", "n_empty", "n_invalid", "n_repeated")  # a row and a row


def layer(vertices: DataFrame, *also: str) -> DataFrame:
    """code, the sides x0 … y1 of each polygon (all its parts and holes), and other columns that its vertices share."""
    rows = normalised(vertices).select("code", *XY)
    return rows.join(vertices.select("code", *also).dropDuplicates(["code"]), "code").select("code", *also, *XY) if also else rows


def flat(sides_: DataFrame, tile: float, key: str = "code") -> DataFrame:
    """Sides of polygons without parts that overlap: those of a polygon whose points don't all count once are replaced by its boundary. key, x0 … y1."""
    own = materialize(sides_.select(key, *XY), "sides")
    # a winding of 0 and 1 is its own square, over the whole plane
    piece = P.pieces(own, [key], tile)
    a, b = (piece.select(key, "tx", "ty", *(F.col(v).alias(f"{s}_{v}") for v in ("xa", "ya", "xb", "yb", "s"))) for s in "lr")
    part = F.col("l_s") * F.col("r_s") * P._over_both((F.col("ty") + 1 + P.SHIFT_Y) * tile)
    square = a.join(b, [key, "tx", "ty"]).where("l_xa < r_xb and r_xa < l_xb").groupBy(key).agg(F.sum(part).alias("square"))
    bad = square.join(P.area(own, key), key).where(F.abs(F.col("square") - F.col("area")) > 1e-9 * F.greatest(F.lit(1.0), F.abs("area"))).select(key)
    bad = materialize(bad, "uneven")
    if bad.isEmpty():
        return own
    return own.join(bad, key, "left_anti").unionByName(P.boundary(own.join(bad, key, "left_semi"), [key], tile))


def points_in_polygons(points: DataFrame, polygons: DataFrame, tile: float, x: str = "x", y: str = "y", key: str = "point_id") -> DataFrame:
    """GEO-J1, GEO-3, GEO-J9: points with the polygon that holds them; of several the lexically least code. Points outside all are left out."""
    at = points.select(F.col(key).alias("_key"), F.col(x).alias("x"), F.col(y).alias("y")).distinct()
    held = P.winding(at, polygons.select("code", *XY), tile).where("w > 0").groupBy("_key").agg(F.min("code").alias("code"))
    return points.join(held, F.col(key) == F.col("_key")).drop("_key")


def side_distance(x: Column, y: Column) -> Column:
    """From a point to the side of its row."""
    c = F.col
    dx, dy = c("x1") - c("x0"), c("y1") - c("y0")
    t = F.least(F.greatest(((x - c("x0")) * dx + (y - c("y0")) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
    return F.sqrt(F.pow(x - c("x0") - t * dx, 2) + F.pow(y - c("y0") - t * dy, 2))


def within_or_nearest_polygon(points: DataFrame, polygons: DataFrame, limit: float, x: str = "x", y: str = "y", key: str = "point_id", tile: float | None = None) -> DataFrame:
    """GEO-J2: the holding polygon, else the nearest within the limit (ties by code), else none: adds code, distance, matched_by (within, nearest, none)."""
    size = tile or 4 * limit
    at = points.select(F.col(key).alias("_key"), F.col(x).alias("_x"), F.col(y).alias("_y")).distinct()
    own = polygons.select("code", *XY)
    held = P.winding(at, own, size, x="_x", y="_y").where("w > 0").select("_key", F.lit(0.0).alias("_distance"), "code")
    near = at.withColumns({"tx": P.tile_x(F.col("_x"), size), "ty": P.tile_y(F.col("_y"), size)}).join(P.dealt(own, size, limit), ["tx", "ty"])
    near = near.select("_key", side_distance(F.col("_x"), F.col("_y")).alias("_distance"), "code").where(F.col("_distance") <= limit)
    best = held.unionByName(near).groupBy("_key").agg(F.min(F.struct("_distance", "code")).alias("best"), F.min(F.when(F.col("_distance") == 0, F.col("code"))).alias("on"))
    how = F.when(F.col("best").isNull(), "none").when(F.col("best._distance") > 0, "nearest").otherwise("within")
    return points.join(best, F.col(key) == F.col("_key"), "left").select(*points.columns, F.col("best.code").alias("code"), F.col("best._distance").alias("distance"), how.alias("matched_by"))


def overlay_polygons(left: DataFrame, right: DataFrame, tile: float) -> DataFrame:
    """GEO-J6: positive-area intersections of two layers with their share of either: left, right, area, left_share, right_share. A point counts once, however many parts of a polygon hold it."""
    a, b = flat(left, tile).withColumnRenamed("code", "left"), flat(right, tile).withColumnRenamed("code", "right")
    met = P.shared_area(a, b, tile, "left", "right")
    own = lambda df, k: P.area(df, k).withColumnRenamed("area", f"_{k}")
    both = met.join(own(a, "left"), "left").join(own(b, "right"), "right")
    return both.select("left", "right", "area", (F.col("area") / F.col("_left")).alias("left_share"), (F.col("area") / F.col("_right")).alias("right_share"))


def line_in_polygons(lines: DataFrame, layers: DataFrame, tile: float, key: str = "edge_id") -> DataFrame:
    """GEO-J7: length of each line (x0, y0, x1, y1) in each layer times its factor.

    layers: sides with code, layer, factor, constant (boolean). A constant-factor layer is dissolved first, so its polygons count once where they overlap; those of a
    column-factor layer add up. Factors of a constant layer are one. A line along a border is decided in `border_lines`.
    """
    own = materialize(layers.select("code", "layer", "factor", "constant", *XY), "layers")
    once = P.boundary(own.where("constant").select("layer", "factor", *XY), ["layer", "factor"], tile)
    several = own.where("not constant").withColumn("_of", F.struct("code", "layer", "factor"))
    several = flat(several, tile, "_of").select("_of.layer", "_of.factor", *XY)
    size = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    shares = P.line_shares(lines, once.unionByName(several), tile, key, ["layer", "factor"]).withColumn("part", F.col("share") * size)
    sums = shares.groupBy(key, "layer").agg(F.sum("part").alias("length"), F.sum(F.col("part") * F.col("factor")).alias("penalty"), F.max("along").alias("_along"), *(F.first(k).alias(k) for k in XY))
    sums = materialize(sums, "sums")
    along = materialize(sums.where("_along").select(key, "layer", *XY), "along")
    rest = sums.where("not _along").select(key, "layer", "length", "penalty")
    return rest if along.isEmpty() else rest.unionByName(border_lines(along, own, tile, key))


def border_lines(lines: DataFrame, layers: DataFrame, tile: float, key: str) -> DataFrame:
    """GEO-J7 for lines (key, layer, x0 … y1) that run along borders: key, layer, length, penalty.

    Each line is cut by the lines of all sides of each polygon that it shares a tile with, and each part counts in the polygons that hold its middle, by the half-open rule.
    So a row costs as much as its polygons have sides; lines that cross borders only don't come here.
    """
    c = F.col
    own = layers.select("layer", "code", "factor", "constant", *XY)
    held = ["layer", "code", "factor", "constant"]
    present = P.dealt(own, tile).select(*held, "tx", "ty").unionByName(P.corners(own, held, tile).select(*held, "tx", "ty")).distinct()
    pairs = materialize(P.dealt(lines, tile).select(key, "layer", "tx", "ty").join(present, ["layer", "tx", "ty"]).select(key, *held).distinct(), "pairs")
    line = lines.select(key, "layer", c("x0").alias("_ax"), c("y0").alias("_ay"), (c("x1") - c("x0")).alias("_dx"), (c("y1") - c("y0")).alias("_dy"))
    met = pairs.join(line, [key, "layer"]).join(own, held)
    dx, dy = c("x1") - c("x0"), c("y1") - c("y0")
    t = F.when(c("_dx") * dy != c("_dy") * dx, F.try_divide(dx * (c("y0") - c("_ay")) - dy * (c("x0") - c("_ax")), dx * c("_dy") - c("_dx") * dy))
    cuts = met.select(key, *held, t.alias("t")).where("t between 0 and 1").unionByName(pairs.select(key, *held, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))).distinct()
    parts = cuts.select(key, *held, c("t").alias("lo"), F.lead("t").over(W.partitionBy(key, *held).orderBy("t")).alias("hi")).where("hi - lo > 1e-12")
    mid = (c("lo") + c("hi")) / 2
    at = parts.join(line, [key, "layer"]).withColumns({"_x": c("_ax") + mid * c("_dx"), "_y": c("_ay") + mid * c("_dy")}).join(own, held)
    across = c("x0") + F.try_divide((c("_y") - c("y0")) * dx, dy)
    crossed = F.sum((((c("y0") <= c("_y")) != (c("y1") <= c("_y"))) & (c("_x") < across)).cast("int"))
    inside = at.groupBy(key, *held, "lo", "hi").agg(F.coalesce(crossed, F.lit(0)).alias("n"), F.first(F.sqrt(c("_dx") * c("_dx") + c("_dy") * c("_dy"))).alias("len")).where("n % 2 = 1")
    # of a constant layer what earlier parts cover counts no more
    before = F.max("hi").over(W.partitionBy(key, "layer", "factor", "constant").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1))
    new = F.when(c("constant"), F.greatest(c("hi") - F.greatest("lo", F.coalesce(before, F.lit(0.0))), F.lit(0.0))).otherwise(c("hi") - c("lo"))
    part = inside.withColumn("part", c("len") * new)
    return part.groupBy(key, "layer").agg(F.sum("part").alias("length"), F.sum(c("part") * c("factor")).alias("penalty"))


def dissolve_polygons(polygons: DataFrame, tile: float, within: str | None = None) -> tuple[DataFrame, DataFrame]:
    """GEO-10: polygons joined by overlaps of positive area, transitively; touching only is no overlap. (members, borders): code and component (least code); and the border of each component as sides.

    within: a column of the polygons; those that differ in it stay apart.
    """
    from gridloom.operators.components import connected_components

    own = materialize(polygons.select("code", *XY), "sides")
    links = P.shared_area(own.withColumnRenamed("code", "a"), own.withColumnRenamed("code", "b"), tile, "a", "b", 1e-9).where("a < b").select("a", "b")
    if within:
        of = materialize(polygons.select("code", within).distinct(), "groups")
        links = links.join(of.select(F.col("code").alias("a"), F.col(within).alias("_ga")), "a").join(of.select(F.col("code").alias("b"), F.col(within).alias("_gb")), "b").where("_ga <=> _gb").select("a", "b")
    members = own.select("code").distinct().join(connected_components(links).withColumnRenamed("node", "code"), "code", "left").withColumn("component", F.coalesce("component", "code"))
    members = materialize(members, "members")
    borders = P.boundary(own.join(members, "code").select("component", *XY), ["component"], tile)
    return members, borders


def dissolve_summary(polygons: DataFrame, members: DataFrame, borders: DataFrame, tile: float) -> DataFrame:
    """component, n (polygons), summed (their areas) and dissolved (the border's area)."""
    areas = P.area(flat(polygons, tile), "code").join(members, "code").groupBy("component").agg(F.count("*").alias("n"), F.sum("area").alias("summed"))
    return areas.join(P.area(borders, "component").withColumnRenamed("area", "dissolved"), "component")


def rings(borders: DataFrame, key: str) -> DataFrame:
    """Borders (key, x0 … y1) as vertices: key, ring, seq, x, y, hole. Where borders touch in a point a ring turns left, so rings don't cross; an outer ring turns left, a hole right."""
    from gridloom.operators.components import connected_components

    at = lambda x, y: F.struct((F.round(x, 9) + 0.0).alias("x"), (F.round(y, 9) + 0.0).alias("y"))
    own = borders.select(key, *XY, at("x0", "y0").alias("_from"), at("x1", "y1").alias("_to")).withColumn("_id", F.xxhash64(key, "_from", "_to"))
    own = materialize(own, "borders")
    after = own.select(F.col(key), F.col("_from").alias("_to"), F.col("_id").alias("_next"), (F.col("x1") - F.col("x0")).alias("_ex"), (F.col("y1") - F.col("y0")).alias("_ey"))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    turn = F.atan2(dx * F.col("_ey") - dy * F.col("_ex"), dx * F.col("_ex") + dy * F.col("_ey"))
    linked = own.join(after, [key, "_to"]).groupBy("_id").agg(F.max_by("_next", turn).alias("_next"))
    linked = materialize(linked, "linked")
    ring = connected_components(linked, "_id", "_next").select(F.col("node").alias("_id"), F.col("component").alias("ring"))
    whole = own.join(linked, "_id").join(ring, "_id").select(key, "ring", "_id", "_next", "x0", "y0")
    kind = borders.schema[key].dataType.simpleString()

    def ordered(g: pd.DataFrame) -> pd.DataFrame:
        place = dict(zip(g["_id"], range(len(g)), strict=True))
        to, k, order = g["_next"].tolist(), int(g["_id"].argmin()), []
        for _ in range(len(g)):
            order.append(k)
            k = place[to[k]]
        out = g.iloc[order]
        x, y = out["x0"].to_numpy(), out["y0"].to_numpy()
        signed = float((x * (y[[*range(1, len(y)), 0]]) - x[[*range(1, len(x)), 0]] * y).sum())
        return pd.DataFrame({key: out[key].tolist(), "ring": out["ring"].tolist(), "seq": range(len(out)), "x": x, "y": y, "hole": signed < 0})

    return whole.groupBy(key, "ring").applyInPandas(ordered, f"`{key}` {kind}, ring long, seq int, x double, y double, hole boolean")


def clip_features(features: DataFrame, area: DataFrame, tile: float) -> tuple[DataFrame, DataFrame]:
    """GEO-11: features (vertices; a repeated code is read once, by its first rows) cut to a study area (vertices): (measures, borders): code, source, clipped; and the clipped borders as sides. Features outside are left out."""
    own = flat(layer(features.dropDuplicates([*RING, "seq"])), tile)
    whole = P.boundary(layer(area).select(F.lit(0).alias("_area"), *XY), ["_area"], tile).drop("_area")
    cut = P.clip(own, whole, tile, "code")
    clipped = P.area(cut, "code").withColumnRenamed("area", "clipped").where("clipped > 1e-12")
    return P.area(own, "code").withColumnRenamed("area", "source").join(clipped, "code"), cut


def clip_lines(lines: DataFrame, area: DataFrame, tile: float, key: str) -> tuple[DataFrame, DataFrame]:
    """GEO-11 for lines (key, x0 … y1): (measures, parts): key, source and clipped length; and the parts within the area (vertices)."""
    whole = P.boundary(layer(area).select(F.lit(0).alias("_area"), *XY), ["_area"], tile).drop("_area")
    parts = P.clip_lines(lines, whole, tile, key)
    size = F.sum(F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2)))
    return lines.groupBy(key).agg(size.alias("source")).join(parts.groupBy(key).agg(size.alias("clipped")), key), parts


def outer_boxes(polygons: DataFrame, keys: Sequence[str], code: str = "code") -> DataFrame:
    """Sides (keys, x0 … y1) of polygons without those of upright rectangles that lie within another rectangle of the same keys and low corner: copies and nested ones add nothing to a union."""
    c = F.col
    upright = (c("x0") == c("x1")) | (c("y0") == c("y1"))
    low = [F.min(F.least("x0", "x1")).alias("_x"), F.min(F.least("y0", "y1")).alias("_y"), F.max(F.greatest("x0", "x1")).alias("_X1"), F.max(F.greatest("y0", "y1")).alias("_Y1")]
    of = polygons.groupBy(*keys, code).agg(F.count("*").alias("_n"), F.bool_and(upright).alias("_up"), (F.sum(c("x0") * c("y1") - c("x1") * c("y0")) / 2).alias("_a"), *low)
    # four upright sides around the whole of their bounds
    whole = (c("_X1") - c("_x")) * (c("_Y1") - c("_y"))
    box = of.where((c("_n") == 4) & c("_up") & (F.abs(c("_a") - whole) <= 1e-9 * F.greatest(F.lit(1.0), whole))).select(*keys, code, "_x", "_y", "_X1", "_Y1")
    wider = W.partitionBy(*keys, "_x", "_y").orderBy(F.desc("_X1")).rowsBetween(W.unboundedPreceding, -1)
    tall = box.groupBy(*keys, "_x", "_y", "_X1").agg(F.max("_Y1").alias("_Y1")).withColumn("_m", F.max("_Y1").over(wider)).where("_m is null or _Y1 > _m")
    ends = (("_x", "_y", "_X1", "_y"), ("_X1", "_y", "_X1", "_Y1"), ("_X1", "_Y1", "_x", "_Y1"), ("_x", "_Y1", "_x", "_y"))
    side = F.explode(F.array(*(F.struct(*(c(v).alias(k) for v, k in zip(e, XY, strict=True))) for e in ends)))
    rest = polygons.join(box.select(*keys, code), [*keys, code], "left_anti").select(*keys, *XY)
    return rest.unionByName(tall.select(*keys, side.alias("_s")).select(*keys, "_s.*"))


def union_coverage(regions: DataFrame, features: DataFrame, tile: float, sources: Sequence[str], source: str = "source") -> DataFrame:
    """STO-3: code and, for each source, the part of the region's area that lies in at least one of its features: union first, so nothing counts twice and no share needs a bound.

    regions, features: sides; features with a source column. Every source is a column; regions without any are 0.
    """
    own = flat(regions, tile)
    union = P.boundary(outer_boxes(features, [source]), [source], tile)
    shared = P.shared_area(own, union, tile, "code", source)
    share = shared.join(P.area(own, "code").withColumnRenamed("area", "_own"), "code").withColumn("share", F.col("area") / F.col("_own"))
    wide = share.groupBy("code").pivot(source, list(sources)).agg(F.sum("share"))
    return own.select("code").distinct().join(wide, "code", "left").na.fill(0.0, list(sources))


def population_exposure(areas: DataFrame, centres: DataFrame, bands: DataFrame, tile: float, density: str) -> DataFrame:
    """GEO-14: code, centre, area, share (of the area), density, band and factor: what areas (sides with code, jurisdiction) share with population centres (sides with centre, jurisdiction, density) of the same jurisdiction.

    bands: band, lower, upper, lower_inclusive, upper_inclusive, factor.
    """
    from gridloom.operators.prepare import classify_bands

    areas, centres = materialize(areas, "areas"), materialize(centres, "centres")
    a, b = flat(areas, tile), flat(centres, tile, "centre")
    met = P.shared_area(a, b, tile, "code", "centre").join(P.area(a, "code").withColumnRenamed("area", "_own"), "code")
    same = met.join(areas.select("code", F.col("jurisdiction").alias("_j")).distinct(), "code").join(centres.select("centre", F.col("jurisdiction").alias("_k"), density).distinct(), "centre").where("_j = _k")
    out = classify_bands(same, bands.drop("factor"), density, ["code", "centre"]).join(bands.select("band", "factor"), "band", "left")
    return out.select("code", "centre", "area", (F.col("area") / F.col("_own")).alias("share"), density, "band", "factor")
