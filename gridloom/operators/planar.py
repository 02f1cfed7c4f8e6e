"""Directed sides of polygons dealt to tiles: windings, areas, lengths, unions and clips as sums over a shuffle.

A layer is a table of sides: key columns, x0, y0, x1, y1, the inside to the left. No row holds a polygon. Each side goes to the tiles it touches, and each tile that a
polygon covers gets the winding number of its lower right corner, from the sides that cross the tile's lower line. What a tile needs to know of a polygon is then in the
tile: the winding of a point is the corner's plus the sides between the two; a polygon is the area above its sides, less and more, in each tile. So a polygon costs rows in
proportion to its sides and the tiles it covers, whatever its size, and a join meets on tiles.

Tile lines lie off the round numbers that coordinates are made of, so no vertex or border point lies on one. A point on a border counts as in or out by the half-open
rule of horizontal rays: one on the left border is in, one on the right is out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.session import drop_folder, materialize

#: Where tile lines lie, as parts of a tile.
SHIFT_X, SHIFT_Y = 0.38196601125010515, 0.7548776662466927
#: Sides touch a tile within this part of it; cuts nearer than NEAR (of a unit) are one.
TOUCH, NEAR = 1e-9, 1e-10
XY = ("x0", "y0", "x1", "y1")


def _at(v: Column, tile: float, shift: float) -> Column:
    return v / tile - shift


def tile_x(x: Column, tile: float) -> Column:
    return F.floor(_at(x, tile, SHIFT_X))


def tile_y(y: Column, tile: float) -> Column:
    return F.floor(_at(y, tile, SHIFT_Y))


def orient(x: Column, y: Column, x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> Column:
    """Positive where a point lies left of the side of its row, negative right."""
    c = F.col
    return (c(x1) - c(x0)) * (y - c(y0)) - (x - c(x0)) * (c(y1) - c(y0))


def dealt(sides: DataFrame, tile: float, margin: float = 0.0) -> DataFrame:
    """Sides with tx, ty: a row for each tile that a side comes within the margin of. Row by row of tiles, so a long slanted side doesn't fill its bounding box."""
    c = F.col
    reach = margin + TOUCH * tile
    lo, hi = F.least("y0", "y1"), F.greatest("y0", "y1")
    rows = sides.withColumn("ty", F.explode(F.sequence(tile_y(lo - reach, tile), tile_y(hi + reach, tile))))
    base = (c("ty") + SHIFT_Y) * tile
    # the part of the side that lies in the row, margin included
    along = lambda y: F.when(c("y0") == c("y1"), F.lit(None)).otherwise(F.least(F.greatest((y - c("y0")) / (c("y1") - c("y0")), F.lit(0.0)), F.lit(1.0)))
    x_at = lambda y, else_: F.coalesce(c("x0") + along(y) * (c("x1") - c("x0")), c(else_))
    a, b = x_at(base - reach, "x0"), x_at(base + tile + reach, "x1")
    return rows.withColumn("tx", F.explode(F.sequence(tile_x(F.least(a, b) - reach, tile), tile_x(F.greatest(a, b) + reach, tile))))


def crossed_lines(sides: DataFrame, tile: float) -> DataFrame:
    """A row for each lower line of a row of tiles (ty) that a side crosses: where (x), and sign (1 upward, -1 downward)."""
    first, last = tile_y(F.least("y0", "y1"), tile) + 1, tile_y(F.greatest("y0", "y1"), tile)
    rows = sides.where(first <= last).withColumn("ty", F.explode(F.sequence(first, last)))
    y = (F.col("ty") + SHIFT_Y) * tile
    x = F.col("x0") + (y - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    return rows.withColumns({"x": x, "sign": F.when(F.col("y1") > F.col("y0"), 1).otherwise(-1)})


def corners(sides: DataFrame, keys: Sequence[str], tile: float) -> DataFrame:
    """keys, tx, ty, w: the winding number of each tile's lower right corner, where it isn't 0."""
    cells = crossed_lines(sides, tile).withColumn("c", tile_x(F.col("x"), tile)).groupBy(*keys, "ty", "c").agg(F.sum("sign").alias("s")).where("s <> 0")
    w = W.partitionBy(*keys, "ty").orderBy(F.desc("c"))
    # between two columns of crossings the winding stays: the sum of all crossings further right
    runs = cells.withColumns({"w": F.sum("s").over(w.rowsBetween(W.unboundedPreceding, 0)), "from": F.lead("c").over(w)}).where("w <> 0 and from is not null")
    return runs.select(*keys, "ty", F.explode(F.sequence(F.col("from"), F.col("c") - 1)).alias("tx"), F.col("w").cast("int").alias("w"))


def _crossing(px: Column, py: Column) -> tuple[Column, Column]:
    """Whether the side of a row passes the height of a point upward, or downward: half-open."""
    c = F.col
    return (c("y0") <= py) & (c("y1") > py), (c("y1") <= py) & (c("y0") > py)


def winding(points: DataFrame, sides: DataFrame, tile: float, on: Sequence[str] = (), x: str = "x", y: str = "y", piece: bool = False) -> DataFrame:
    """Sums over the sides: the columns of points, the other columns of sides' keys, and w, the winding number of the point, where it isn't 0.

    sides: keys and x0 … y1; on: keys that points have too and must share. piece: points are middles of lines (columns _p0x, _p0y, _p1x, _p1y); sides that lie along
    the line count apart, in net (1 the same way, -1 the other way), and w is the winding just right of the point (above it, where the line is level). Rows where both
    are 0 are left out. The columns of points must tell them apart.
    """
    c = F.col
    keys = [k for k in sides.columns if k not in XY]
    own = [k for k in keys if k not in on]
    at = points.withColumns({"tx": tile_x(c(x), tile), "ty": tile_y(c(y), tile)})
    meet = [*on, "tx", "ty"]
    met = at.join(dealt(sides, tile), meet)
    gx, cy = (c("tx") + 1 + SHIFT_X) * tile, (c("ty") + SHIFT_Y) * tile
    up, down = _crossing(c(x), c(y))
    passed = lambda o: F.when(up & (o > 0), 1).when(down & (o < 0), -1).otherwise(0)
    foot, corner = orient(gx, c(y)), orient(gx, cy)
    right, left = (c("x0") <= gx) & (c("x1") > gx), (c("x1") <= gx) & (c("x0") > gx)
    stepped = F.when(right & (corner < 0) & (foot >= 0), 1).when(left & (corner > 0) & (foot <= 0), -1).otherwise(0)
    # a point on a border is decided by where the whole side passes its height, whatever the tile
    across = c("x0") + F.try_divide((c(y) - c("y0")) * (c("x1") - c("x0")), c("y1") - c("y0"))
    here = F.when(up & (c(x) < across), 1).when(down & (c(x) < across), -1).otherwise(0)
    there, net = passed(foot), F.lit(0)
    if piece:
        along, level = _along(), _level()
        # of a side along the line the point lies just right, or just above where the line is level, however its last digits fall
        here, there = F.when(along, 0).otherwise(passed(orient(c(x), c(y)))), F.when(along & level, 0).otherwise(there)
        stepped = F.when(along & level, F.when(right & (corner < 0), 1).when(left & (corner > 0), -1).otherwise(0)).otherwise(stepped)
        net = F.when(along, F.when((c("_p1x") - c("_p0x")) * (c("x1") - c("x0")) + (c("_p1y") - c("_p0y")) * (c("y1") - c("y0")) > 0, 1).otherwise(-1)).otherwise(0)
    parts = met.select(*points.columns, *own, (here - there + stepped).alias("w"), net.alias("net")).where("w <> 0 or net <> 0")
    base = at.join(corners(sides, keys, tile), meet).select(*points.columns, *own, "w", F.lit(0).alias("net"))
    sums = parts.unionByName(base).groupBy(*points.columns, *own).agg(F.sum("w").alias("w"), F.sum("net").alias("net"))
    return sums.where("w <> 0 or net <> 0") if piece else sums.drop("net").where("w <> 0")


def _along() -> Column:
    """Whether the side of a row lies along the line _p0-_p1, its middle within the side."""
    c = F.col
    size = F.sqrt(F.pow(c("x1") - c("x0"), 2) + F.pow(c("y1") - c("y0"), 2))
    off = F.greatest(F.abs(orient(c("_p0x"), c("_p0y"))), F.abs(orient(c("_p1x"), c("_p1y")))) / size
    mx, my = (c("_p0x") + c("_p1x")) / 2, (c("_p0y") + c("_p1y")) / 2
    place = ((mx - c("x0")) * (c("x1") - c("x0")) + (my - c("y0")) * (c("y1") - c("y0"))) / (size * size)
    return (off <= NEAR) & (place > 0) & (place < 1)


def _level() -> Column:
    c = F.col
    return F.abs(c("_p1y") - c("_p0y")) <= 1e-7 * F.abs(c("_p1x") - c("_p0x"))


def pieces(sides: DataFrame, keys: Sequence[str], tile: float) -> DataFrame:
    """keys, tx, ty, xa, ya, xb, yb, s (xa < xb): in each tile the winding number of a point is the sum of s over the pieces that pass below it.

    Pieces are the sides cut to the tile, and for what lies under the tile its lower line, as far as the polygon reaches over it. Upright sides bound nothing from below.
    """
    c = F.col
    rows = dealt(sides.where("x0 <> x1"), tile)
    lo_x, lo_y = (c("tx") + SHIFT_X) * tile, (c("ty") + SHIFT_Y) * tile
    lo, hi = F.lit(0.0), F.lit(1.0)
    for p, q in ((c("x0") - c("x1"), c("x0") - lo_x), (c("x1") - c("x0"), lo_x + tile - c("x0")), (c("y0") - c("y1"), c("y0") - lo_y), (c("y1") - c("y0"), lo_y + tile - c("y0"))):
        t = F.try_divide(q, p)
        lo = F.greatest(lo, F.when(p < 0, t).when((p == 0) & (q < 0), 2.0).otherwise(0.0))
        hi = F.least(hi, F.when(p > 0, t).when((p == 0) & (q < 0), -1.0).otherwise(1.0))
    cut = rows.withColumns({"_lo": lo, "_hi": hi}).where("_lo < _hi")
    x_of, y_of = (lambda t: c("x0") + t * (c("x1") - c("x0"))), (lambda t: c("y0") + t * (c("y1") - c("y0")))
    way = c("x1") > c("x0")
    first, last = F.when(way, c("_lo")).otherwise(c("_hi")), F.when(way, c("_hi")).otherwise(c("_lo"))
    own = cut.select(*keys, "tx", "ty", x_of(first).alias("xa"), y_of(first).alias("ya"), x_of(last).alias("xb"), y_of(last).alias("yb"), F.when(way, 1).otherwise(-1).alias("s"))
    # the lower line: each crossing adds its sign to all that lies left of it
    lines = crossed_lines(sides, tile).withColumn("tx", tile_x(c("x"), tile)).select(*keys, "tx", "ty", lo_x.alias("xa"), lo_y.alias("ya"), c("x").alias("xb"), lo_y.alias("yb"), c("sign").alias("s"))
    whole = corners(sides, keys, tile).select(*keys, "tx", "ty", lo_x.alias("xa"), lo_y.alias("ya"), (lo_x + tile).alias("xb"), lo_y.alias("yb"), c("w").alias("s"))
    return own.unionByName(lines).unionByName(whole)


def area(sides: DataFrame, *keys: str) -> DataFrame:
    """keys and area: of what lies left of the sides; parts that overlap count as often as they do."""
    return sides.groupBy(*keys).agg((F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2).alias("area"))


def _over_both(top: Column) -> Column:
    """The area over both of two pieces (l_, r_) and under the line top, where they share x."""
    lo, hi = F.greatest("l_xa", "r_xa"), F.least("l_xb", "r_xb")
    at = lambda s, x: F.col(f"{s}_ya") + (F.col(f"{s}_yb") - F.col(f"{s}_ya")) * (x - F.col(f"{s}_xa")) / (F.col(f"{s}_xb") - F.col(f"{s}_xa"))
    dl, dh = at("l", lo) - at("r", lo), at("l", hi) - at("r", hi)
    upper = (F.greatest(at("l", lo), at("r", lo)) + F.greatest(at("l", hi), at("r", hi))) / 2
    # where they cross the upper line has a kink there, under the chord
    kink = F.when(dl * dh < 0, F.abs(dl * dh) / (F.abs(dl) + F.abs(dh)) / 2).otherwise(0.0)
    return F.when(hi > lo, (hi - lo) * (top - upper + kink)).otherwise(0.0)


def shared_area(left: DataFrame, right: DataFrame, tile: float, left_key: str, right_key: str, least: float = 1e-12) -> DataFrame:
    """left_key, right_key, area: what polygons of two layers share, where it is more than `least`: over all pairs of pieces of a tile. Layers without overlapping parts count each point once."""
    side = lambda df, k, s: pieces(df, [k], tile).select("tx", "ty", F.col(k).alias(f"{s}_key"), *(F.col(v).alias(f"{s}_{v}") for v in ("xa", "ya", "xb", "yb", "s")))
    met = side(left, left_key, "l").join(side(right, right_key, "r"), ["tx", "ty"]).where("l_xa < r_xb and r_xa < l_xb")
    part = F.col("l_s") * F.col("r_s") * _over_both((F.col("ty") + 1 + SHIFT_Y) * tile)
    return met.groupBy(F.col("l_key").alias(left_key), F.col("r_key").alias(right_key)).agg(F.sum(part).alias("area")).where(F.col("area") > least)


def line_shares(lines: DataFrame, sides: DataFrame, tile: float, key: str, keys: Sequence[str]) -> DataFrame:
    """key, keys, share, along, x0 … y1: the part of each line that lies in each polygon: over all pieces of a tile, the part that passes above, times the piece's sign; and whether it lies along one.

    Pieces are written, so Spark knows their size before it joins: few ones meet the lines where these are. Of a tile's pieces a line meets those that it passes over.
    """
    c = F.col
    slope = (c("yb") - c("ya")) / (c("xb") - c("xa"))
    bits = materialize(pieces(sides, keys, tile).where("xa < xb").select(*keys, "tx", "ty", "xa", "xb", "s", "ya", slope.alias("_slope"), F.least("ya", "yb").alias("_low")), "pieces")
    # a line is cut to its tiles like a side, as an interval of its length
    dx, dy = c("x1") - c("x0"), c("y1") - c("y0")
    rows = dealt(lines.select(key, *XY), tile)
    rows = rows.withColumns({"_dx": dx, "_dy": dy, "_inv": F.try_divide(F.lit(1.0), dx), "_ls": (c("tx") + SHIFT_X) * tile, "_bs": (c("ty") + SHIFT_Y) * tile})
    ends = {"_l": F.try_divide(c("_ls") - c("x0"), dx), "_r": F.try_divide(c("_ls") + tile - c("x0"), dx), "_b": F.try_divide(c("_bs") - c("y0"), dy), "_t": F.try_divide(c("_bs") + tile - c("y0"), dy)}
    # where a line is upright or level two of them are null, which greatest and least skip
    lo, hi = F.greatest(F.lit(0.0), F.least("_l", "_r"), F.least("_b", "_t")), F.least(F.lit(1.0), F.greatest("_l", "_r"), F.greatest("_b", "_t"))
    within = ((c("_dx") != 0) | ((c("x0") >= c("_ls")) & (c("x0") < c("_ls") + tile))) & ((c("_dy") != 0) | ((c("y0") >= c("_bs")) & (c("y0") < c("_bs") + tile)))
    cut = rows.withColumns(ends).withColumns({"_lo": lo, "_hi": hi}).where((c("_lo") < c("_hi")) & within)
    at = lambda v, d, f: f(c(v) + c("_lo") * d, c(v) + c("_hi") * d)
    cut = cut.select(key, *XY, "tx", "ty", "_dx", "_dy", "_inv", "_lo", "_hi", (at("x0", dx, F.least) - NEAR).alias("_left"), (at("x0", dx, F.greatest) + NEAR).alias("_right"), (at("y0", dy, F.greatest) + 2 * NEAR).alias("_top"))
    cut = cut.repartition(key)  # in one stage with the join the generated method is too long for the JVM to compile
    ours, piece = cut.alias("l"), bits.alias("p")
    near = (c("l.tx") == c("p.tx")) & (c("l.ty") == c("p.ty")) & (c("xa") <= c("_right")) & (c("xb") >= c("_left")) & (c("_low") <= c("_top"))
    met = ours.join(piece, near).drop("tx", "ty")
    # x within the piece
    ta, tb = (c("xa") - c("x0")) * c("_inv"), (c("xb") - c("x0")) * c("_inv")
    over = (c("xa") <= c("x0")) & (c("x0") < c("xb"))
    from_ = F.when(c("_inv").isNull(), F.when(over, c("_lo")).otherwise(2.0)).otherwise(F.greatest(c("_lo"), F.least(ta, tb)))
    to = F.when(c("_inv").isNull(), c("_hi")).otherwise(F.least(c("_hi"), F.greatest(ta, tb)))
    met = met.withColumns({"_from": from_, "_to": to}).where("_from < _to")
    # height above the piece at both ends
    above = lambda t: c("y0") - c("ya") - c("_slope") * (c("x0") - c("xa")) + c(t) * (c("_dy") - c("_slope") * c("_dx"))
    met = met.select(key, *XY, *keys, "s", "_slope", (c("_to") - c("_from")).alias("_size"), above("_from").alias("_a"), above("_to").alias("_b"))
    most, least = F.greatest("_a", "_b"), F.least("_a", "_b")
    # a line along the piece counts as the border rule says: above it unless it rises
    along = (most <= NEAR) & (least >= -NEAR)
    part = F.when(along, F.when(c("_slope") <= 0, 1.0).otherwise(0.0)).when(least >= 0, 1.0).when(most <= 0, 0.0).otherwise(F.try_divide(most, most - least))
    sums = [F.sum(part * c("_size") * c("s")).alias("share"), F.max(along).alias("along"), *(F.first(k).alias(k) for k in XY)]
    return met.groupBy(key, *keys).agg(*sums)


def _cuts(t: Column, u: Column) -> Column:
    return F.when((t > 0) & (t < 1) & (u >= -TOUCH) & (u <= 1 + TOUCH), t)


def cut(sides: DataFrame, blades: DataFrame, tile: float, on: Sequence[str] = (), side: str = "_side", but: str | None = None) -> DataFrame:
    """Sides cut where blades meet them: the columns of sides, with the ends of each part as _p0x … _p1y and its middle _mx, _my.

    blades: the columns `on` and x0 … y1; a blade and a side meet in a tile and share `on`. side: a column that tells sides apart; but: blades of the same value in this column don't count.
    """
    c = F.col
    a = dealt(sides, tile)
    b = dealt(blades.select(*on, *([F.col(but).alias("_but")] if but else []), *(F.col(k).alias(f"b{k}") for k in XY)).select("*", *(F.col(f"b{k}").alias(k) for k in XY)), tile).drop(*XY)
    met = a.join(b, [*on, "tx", "ty"])
    if but:
        met = met.where(c(but) != c("_but"))
    dx, dy, ex, ey = c("x1") - c("x0"), c("y1") - c("y0"), c("bx1") - c("bx0"), c("by1") - c("by0")
    size = F.sqrt(dx * dx + dy * dy)
    det = dx * ey - dy * ex
    level = F.abs(det) <= 1e-12 * size * F.sqrt(ex * ex + ey * ey)
    t, u = F.try_divide((c("bx0") - c("x0")) * ey - (c("by0") - c("y0")) * ex, det), F.try_divide((c("bx0") - c("x0")) * dy - (c("by0") - c("y0")) * dx, det)
    near = F.greatest(F.abs(orient(c("bx0"), c("by0"))), F.abs(orient(c("bx1"), c("by1")))) <= NEAR * size
    place = lambda x, y: ((c(x) - c("x0")) * dx + (c(y) - c("y0")) * dy) / (size * size)
    inner = lambda v: F.when((v > 0) & (v < 1), v)
    ts = F.when(~level, F.array(_cuts(t, u))).when(near, F.array(inner(place("bx0", "by0")), inner(place("bx1", "by1"))))
    at = met.select(*on, side, F.explode(F.array_compact(ts)).alias("_t")).groupBy(*on, side).agg(F.array_sort(F.collect_set("_t")).alias("_ts"))
    whole = sides.join(at, [*on, side], "left").withColumn("_ts", F.concat(F.array(F.lit(0.0)), F.coalesce("_ts", F.array().cast("array<double>")), F.array(F.lit(1.0))))
    parts = F.zip_with(F.slice("_ts", F.lit(1), F.size("_ts") - 1), F.slice("_ts", F.lit(2), F.size("_ts") - 1), lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")))
    rows = whole.select(*sides.columns, F.explode(parts).alias("_p")).where((c("_p.hi") - c("_p.lo")) * size > NEAR)
    end = lambda t, v: c(f"{v}0") + c(f"_p.{t}") * (c(f"{v}1") - c(f"{v}0"))
    mid = (c("_p.lo") + c("_p.hi")) / 2
    ends = {"_p0x": end("lo", "x"), "_p0y": end("lo", "y"), "_p1x": end("hi", "x"), "_p1y": end("hi", "y")}
    return rows.withColumns(ends | {"_mx": c("x0") + mid * dx, "_my": c("y0") + mid * dy}).drop("_p", *XY)


_ENDS = ("_p0x", "_p0y", "_p1x", "_p1y", "_mx", "_my")


def _sided(w: Column, net: Column) -> tuple[Column, Column]:
    """Windings left and right of a piece from what winding(piece=True) gives: w is right of it if it goes up or, level, to the left."""
    c = F.col
    dy, dx = c("_p1y") - c("_p0y"), c("_p1x") - c("_p0x")
    to_right = F.when(_level(), dx < 0).otherwise(dy > 0)
    return F.when(to_right, w + net).otherwise(w), F.when(to_right, w).otherwise(w - net)


def _turned(df: DataFrame, keys: Sequence[str], inside_left: Column) -> DataFrame:
    """Pieces as sides with the inside to their left, pieces of equal ends once."""
    c = F.col
    pick = lambda a, b, n: F.when(inside_left, c(a)).otherwise(c(b)).alias(n)
    rows = df.select(*keys, pick("_p0x", "_p1x", "x0"), pick("_p0y", "_p1y", "y0"), pick("_p1x", "_p0x", "x1"), pick("_p1y", "_p0y", "y1"))
    return rows.withColumns({f"_{k}": F.round(k, 9) + 0.0 for k in XY}).dropDuplicates([*keys, *(f"_{k}" for k in XY)]).select(*keys, *XY)


def _closed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Written, with one point for all ends within 1e-9: ends cut from different sides differ in their last digits, and a ray must not pass between them."""
    rows = materialize(df, "open")
    near = lambda x, y: F.struct((F.round(x, 9) + 0.0).alias("x"), (F.round(y, 9) + 0.0).alias("y"))
    ends = rows.select(*keys, near("x0", "y0").alias("_r"), "x0", "y0").unionAll(rows.select(*keys, near("x1", "y1"), "x1", "y1"))
    one = ends.groupBy(*keys, "_r").agg(F.min(F.struct("x0", "y0")).alias("_p"))
    at = lambda k: one.select(*keys, F.col("_r").alias(f"_r{k}"), F.col("_p.x0").alias(f"_x{k}"), F.col("_p.y0").alias(f"_y{k}"))
    out = rows.withColumns({"_r0": near("x0", "y0"), "_r1": near("x1", "y1")}).join(at(0), [*keys, "_r0"]).join(at(1), [*keys, "_r1"])
    out = out.select(*keys, *(F.col(f"_{k}").alias(k) for k in XY)).where("x0 <> x1 or y0 <> y1")
    out = materialize(out, "boundary")
    drop_folder(rows)
    return out


def boundary(sides: DataFrame, keys: Sequence[str], tile: float) -> DataFrame:
    """The sides of the union of all rings of each key: sides cut at their crossings, those kept that have winding 0 on one side only, each once, the inside to the left.

    Parts that overlap become one, what lies in several counts once; borders that two parts share from both sides go, touching corners stay.
    """
    every = materialize(sides.select(*keys, *XY), "sides")
    # equal sides count as often as they are there, which the winding sees; cutting them once is enough
    own = every.withColumn("_side", F.xxhash64(*keys, *XY)).dropDuplicates([*keys, *XY])
    middles = materialize(cut(own, own, tile, keys, but="_side").drop("_side"), "middles")
    found = winding(middles, every, tile, keys, "_mx", "_my", piece=True)
    left, right = _sided(F.col("w"), F.col("net"))
    out = _closed(_turned(found.where((left > 0) != (right > 0)), keys, left > 0), keys)
    drop_folder(every)
    drop_folder(middles)
    return out


def clip(features: DataFrame, area_sides: DataFrame, tile: float, key: str) -> DataFrame:
    """The sides of each feature (key, x0 … y1) cut to an area (x0 … y1), each point of both counted once: sides of the feature within the area, and of the area within the feature. Both are boundaries: boundary() makes them."""
    c = F.col
    f = materialize(features.select(key, *XY).withColumn("_side", F.xxhash64(key, *XY)), "features")
    a = materialize(area_sides.select(*XY).withColumn("_side", F.xxhash64(*XY)), "area")
    one = materialize(cut(f, a, tile).drop("_side"), "parts")
    held = winding(one, a.select(*XY, F.lit(1).alias("_area")), tile, (), "_mx", "_my", piece=True).drop("_area")
    left, _ = _sided(c("w"), c("net"))
    # a side along the area's border stays if both have their inside on the same side of it
    of_feature = _turned(held.where(left > 0), [key], F.lit(True))
    # sides of the area that share a tile with a feature, or lie in one that it covers
    present = dealt(f.drop("_side"), tile).select(key, "tx", "ty").unionByName(corners(f.drop("_side"), [key], tile).select(key, "tx", "ty")).distinct()
    pairs = materialize(dealt(a, tile).join(present, ["tx", "ty"]).select(key, "_side", *XY).distinct(), "pairs")
    other = materialize(cut(pairs, f.select(key, *XY), tile, [key]).drop("_side"), "others")
    inner = winding(other, f.drop("_side"), tile, [key], "_mx", "_my", piece=True)
    of_area = _turned(inner.where((c("net") == 0) & (c("w") > 0)), [key], F.lit(True))
    out = _closed(of_feature.unionByName(of_area), [key])
    for used in (f, a, one, pairs, other):
        drop_folder(used)
    return out


def clip_lines(lines: DataFrame, area_sides: DataFrame, tile: float, key: str) -> DataFrame:
    """The parts of lines (key, x0 … y1) that lie in an area: key, x0 … y1."""
    own = materialize(lines.select(key, *XY).withColumn("_side", F.xxhash64(key, *XY)).dropDuplicates([key, *XY]), "lines")
    area_ = materialize(area_sides.select(*XY, F.lit(1).alias("_area")), "area")
    parts = materialize(cut(own, area_, tile).drop("_side"), "parts")
    held = winding(parts, area_, tile, (), "_mx", "_my", piece=True)
    left, right = _sided(F.col("w"), F.col("net"))
    out = materialize(held.where((left > 0) | (right > 0)).select(key, *(F.col(p).alias(k) for p, k in zip(_ENDS[:4], XY, strict=True))), "clipped")
    for used in (own, area_, parts):
        drop_folder(used)
    return out
