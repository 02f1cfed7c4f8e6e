"""Polygon operators on known shapes, and against sampled points."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import geometry as S
from gridloom.operators import planar as P
from gridloom.operators import polygons as G

VERTICES = "code string, part int, ring int, seq int, x double, y double"


def layer(spark, polygons):
    """polygons: {code: [[outer, hole, …], …]} of point lists."""
    rows = [(c, p, r, k, float(x), float(y)) for c, parts in polygons.items() for p, rings in enumerate(parts) for r, ring in enumerate(rings) for k, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, VERTICES)


def odd(rings, x, y):
    n = 0
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
            n += (y0 <= y) != (y1 <= y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0)
    return n % 2 == 1


U = [[(0, 0), (6, 0), (6, 5), (4, 5), (4, 2), (2, 2), (2, 5), (0, 5)]]
HOLED = [[(3, 3), (9, 3), (9, 9), (3, 9)], [(5, 5), (5, 7), (7, 7), (7, 5)]]
STAR = [[(1, 1), (5, 2), (8, 1), (6, 4), (8, 8), (4, 5), (1, 8), (2, 4)]]


def test_normalised_rings(spark):
    shape = {"a": [[[(0, 0), (0, 2), (2, 2), (2, 2), (2, 0), (0, 0)], [(0.5, 0.5), (1, 0.5), (1, 1), (0.5, 1)]], [[(5, 5), (6, 6)]], [[(7, 7), (8, 7), (9, 7)]]]}
    rows = {(r.part, r.ring): (r.n, r.turned, r.area) for r in G.normalised(layer(spark, shape)).groupBy("part", "ring").agg(F.count("*").alias("n"), F.first("turned").alias("turned"), F.first("area").alias("area")).collect()}
    assert rows == {(0, 0): (4, True, 4.0), (0, 1): (4, True, 0.25)}
    assert P.area(G.layer(layer(spark, shape)), "code").first().area == 3.75


def test_points_against_even_odd(spark):
    rng = random.Random(1)
    points = [(i, rng.uniform(-1, 10), rng.uniform(-1, 10)) for i in range(600)]
    shapes = {"b": [U], "a": [HOLED], "c": [STAR, [[(9, 0), (10, 0), (10, 1)]]]}
    held = {r.point_id: r.code for r in G.points_in_polygons(spark.createDataFrame(points, "point_id int, x double, y double"), G.layer(layer(spark, shapes)), 2.5).collect()}
    want = {i: min((c for c, parts in shapes.items() if any(odd(rings, x, y) for rings in parts)), default=None) for i, x, y in points}
    assert held == {i: c for i, c in want.items() if c}


def test_nearest_polygon(spark):
    points = spark.createDataFrame([(1, 3.0, 4.0), (2, 3.0, 1.0), (3, 6.0, 6.0), (4, -1.0, -1.0), (5, 30.0, 0.0)], "point_id int, x double, y double")
    found = {r.point_id: (r.code, r.distance and round(r.distance, 6), r.matched_by) for r in G.within_or_nearest_polygon(points, G.layer(layer(spark, {"u": [U], "h": [HOLED]})), 2.0).collect()}
    assert found[1] == ("h", 0.0, "within") and found[2] == ("u", 0.0, "within") and found[3] == ("h", 1.0, "nearest") and found[4] == ("u", 1.414214, "nearest") and found[5] == (None, None, "none")


@pytest.mark.parametrize("a,b", [(U, HOLED), (U, STAR), (HOLED, STAR), (STAR, STAR)])
def test_shared_area(spark, a, b):
    found = G.overlay_polygons(G.layer(layer(spark, {"a": [a]})), G.layer(layer(spark, {"b": [b]})), 3.0).collect()
    n = 200
    hits = sum(odd(a, x, y) and odd(b, x, y) for i in range(n) for j in range(n) for x, y in [((i + 0.5) * 10 / n, (j + 0.5) * 10 / n)])
    assert len(found) == 1 and found[0].area == pytest.approx(hits * (10 / n) ** 2, abs=0.15)
    if a == b:
        assert found[0].left_share == pytest.approx(1) and found[0].right_share == pytest.approx(1)


def test_line_lengths(spark):
    lines = spark.createDataFrame([(1, -1.0, 3.0, 11.0, 3.0), (2, 0.0, 6.0, 10.0, 6.0), (3, -1.0, -1.0, -1.0, 9.0)], "edge_id int, x0 double, y0 double, x1 double, y1 double")
    shapes = G.layer(layer(spark, {"u": [U], "u2": [U], "h": [HOLED]}))
    kind = F.when(F.col("code") == "h", "open").otherwise("water")
    found = {(r.edge_id, r.layer): (round(r.length, 6), round(r.penalty, 6)) for r in G.line_in_polygons(lines, shapes.select("*", kind.alias("layer"), F.lit(2.0).alias("factor"), (F.col("code") != "h").alias("constant")), 3.0).collect() if r.length}
    assert found == {(1, "water"): (4.0, 8.0), (2, "open"): (4.0, 8.0)} or found == {(1, "water"): (4.0, 8.0), (1, "open"): (6.0, 12.0), (2, "open"): (4.0, 8.0)}
    layers = shapes.select("*", F.lit("sum").alias("layer"), F.lit(1.0).alias("factor"), F.lit(False).alias("constant")).where("code <> 'h'")
    assert G.line_in_polygons(lines.where("edge_id = 1"), layers, 3.0).first().length == pytest.approx(8.0)


def test_equal_rectangles_of_an_additive_layer_add_up(spark):
    edges = spark.createDataFrame([("e", 0.0, 0.0, 4.0, 0.0)], "edge_id string, x0 double, y0 double, x1 double, y1 double")
    rect = ("r", 1.0, False, 1.0, -1.0, 3.0, 1.0)
    layers = spark.createDataFrame([rect, rect], "layer string, factor double, constant boolean, xmin double, ymin double, xmax double, ymax double")
    assert S.line_in_layers(edges, layers, 1.0).first().length == 4.0
    assert S.line_in_layers(edges, layers.withColumn("constant", F.lit(True)), 1.0).first().length == 2.0


@pytest.mark.parametrize("tile", [1.7, 10.0])
def test_points_on_slanted_borders_as_the_formula_says(spark, tile):
    # on the points' grid rounding decides about a border: as it does for the whole side, in every tile
    ring = [(-145.0, 41.0), (-129.0, 42.0), (-133.0, 45.0), (-130.0, 48.0), (-138.0, 46.0), (-144.0, 48.0), (-141.0, 44.5)]
    rng = random.Random(3)
    points = []
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
        for k in rng.sample(range(1601), 300):
            points.append((len(points), -145 + round((x0 + (x1 - x0) * k / 1600 + 145) * 100) / 1e2, 41 + round((y0 + (y1 - y0) * k / 1600 - 41) * 100) / 1e2))
    held = G.points_in_polygons(spark.createDataFrame(points, "point_id int, x double, y double"), G.layer(layer(spark, {"a": [[ring]]})), tile)
    assert {r.point_id for r in held.collect()} == {i for i, x, y in points if odd([ring], x, y)}


def test_lines_along_slanted_borders_as_the_formula_says(spark):
    ring = [(-145.0, 41.0), (-129.0, 42.0), (-133.0, 45.0), (-130.0, 48.0), (-138.0, 46.0), (-144.0, 48.0), (-141.0, 44.5)]
    side = list(zip(ring, ring[1:] + ring[:1], strict=True))
    lines = []
    for (x0, y0), dx, dy in (((-133.0, 45.0), 2, 2), ((-129.0, 42.0), -2.0, 1.5), ((-130.0, 48.0), -4, -1), ((-138.0, 46.0), -3, 1)):
        for k in range(60):
            x, y = -145 + round((x0 + dx * k / 100 + 145) * 100) / 1e2, 41 + round((y0 + dy * k / 100 - 41) * 100) / 1e2
            lines.append((len(lines), x, y, x + dx, y + dy))
    want = {}
    for i, ax, ay, bx, by in lines:
        ts = {0.0, 1.0}
        for (x0, y0), (x1, y1) in side:
            if (bx - ax) * (y1 - y0) != (by - ay) * (x1 - x0):
                ts.add(((x1 - x0) * (y0 - ay) - (y1 - y0) * (x0 - ax)) / ((x1 - x0) * (by - ay) - (bx - ax) * (y1 - y0)))
        ts = sorted(t for t in ts if 0 <= t <= 1)
        part = sum(hi - lo for lo, hi in zip(ts, ts[1:], strict=False) if hi - lo > 1e-12 and odd([ring], ax + (lo + hi) / 2 * (bx - ax), ay + (lo + hi) / 2 * (by - ay)))
        want[i] = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5 * part
    of = G.layer(layer(spark, {"a": [[ring]]}))
    for constant in (True, False):
        found = G.line_in_polygons(spark.createDataFrame(lines, "edge_id int, x0 double, y0 double, x1 double, y1 double"), of.select("*", F.lit("l").alias("layer"), F.lit(1.0).alias("factor"), F.lit(constant).alias("constant")), 4.0)
        found = {r.edge_id: r.length for r in found.collect()}
        assert [i for i in want if abs(found.get(i, 0.0) - want[i]) > 1e-9] == []
