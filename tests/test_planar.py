"""Sides dealt to tiles: windings, unions, clips, coverage and faults against brute force and known areas."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import planar as P
from gridloom.operators import polygons as G
from tests.test_polygons import HOLED, STAR, U, layer, odd


def square(x0, y0, x1, y1):
    return [[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]


def sides(spark, polygons):
    return G.layer(layer(spark, polygons))


def wheel(n, r=10.0, cx=0.123, cy=0.456):
    return [[(cx + r * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)) for k in range(n)]]


@pytest.mark.parametrize("tile", [0.7, 30.0])
def test_winding_of_points_on_and_off_borders(spark, tile):
    shapes = {"b": [U], "a": [HOLED], "c": [STAR, square(9, 0, 10, 1)]}
    rng = random.Random(1)
    at = lambda: rng.choice([rng.uniform(-1, 10), float(rng.randint(-1, 10))])
    points = [(i, at(), at()) for i in range(800)]
    found = {(r.id, r.code): r.w for r in P.winding(spark.createDataFrame(points, "id int, x double, y double"), sides(spark, shapes), tile).collect()}
    assert found == {(i, c): 1 for i, x, y in points for c, parts in shapes.items() if any(odd(rings, x, y) for rings in parts)}


@pytest.mark.parametrize("tile", [0.9, 7.0])
def test_union_counts_each_point_once(spark, tile):
    shapes = {
        "p": [square(20, 0, 22, 2), square(21, 0, 23, 2)],  # overlap
        "q": [square(0, 0, 1, 1), square(1, 0, 2, 1)],  # a shared border
        "r": [square(0, 5, 2, 7), square(0, 5, 2, 7), square(1, 6, 3, 8)],  # one part twice
        "s": [HOLED, square(5.5, 5.5, 8, 6.5)],  # into a hole
        "t": [square(30, 0, 31, 1), square(31, 1, 32, 2)],  # a corner touches
    }
    border = P.boundary(sides(spark, shapes), ["code"], tile)
    assert {r.code: round(r.area, 9) for r in P.area(border, "code").collect()} == {"p": 6.0, "q": 2.0, "r": 7.0, "s": 33.5, "t": 2.0}
    rings = G.rings(border, "code")
    ends = rings.groupBy("code", "ring").agg(F.count("*").alias("n"), F.first("hole").alias("hole")).groupBy("code").agg(F.count("*").alias("rings"), F.count_if("hole").alias("holes"))
    assert {r.code: (r.rings, r.holes) for r in ends.collect()} == {"p": (1, 0), "q": (1, 0), "r": (1, 0), "s": (2, 1), "t": (2, 0)}
    flat = G.flat(sides(spark, shapes), tile)
    assert {r.code: round(r.area, 9) for r in P.area(flat, "code").collect()} == {"p": 6.0, "q": 2.0, "r": 7.0, "s": 33.5, "t": 2.0}


def test_union_against_samples(spark):
    rng = random.Random(8)
    shapes = {}
    for c in "ab":
        shapes[c] = [[[(cx + r * math.cos(a), cy + r * math.sin(a)) for a, r in zip(sorted(rng.uniform(0, 2 * math.pi) for _ in range(7)), [rng.uniform(0.6, 3) for _ in range(7)], strict=True)]] for cx, cy in [(rng.uniform(2, 8), rng.uniform(2, 8)) for _ in range(6)]]
    found = {r.code: r.area for r in P.area(P.boundary(sides(spark, shapes), ["code"], 1.7), "code").collect()}
    n = 240
    for c, parts in shapes.items():
        hits = sum(any(odd(rings, x, y) for rings in parts) for i in range(n) for j in range(n) for x, y in [((i + 0.5) * 12 / n - 1, (j + 0.5) * 12 / n - 1)])
        assert found[c] == pytest.approx(hits * (12 / n) ** 2, abs=0.25)


def test_overlay_of_overlapping_parts(spark):
    parts = {"p": [square(20, 0, 22, 2), square(21, 0, 23, 2)]}
    row = G.overlay_polygons(sides(spark, parts), sides(spark, {"box": [square(20, 0, 23, 2)]}), 1.5).first()
    assert (round(row.area, 9), round(row.left_share, 9), round(row.right_share, 9)) == (6.0, 1.0, 1.0)


def test_dissolve_keeps_touching_parts_apart(spark):
    own = sides(spark, {"a": [square(0, 0, 2, 2)], "b": [square(1, 1, 3, 3)], "c": [square(3, 1, 4, 3)], "d": [square(9, 9, 10, 10)], "e": [square(2.5, 2.5, 2.75, 2.75)]})
    members, borders = G.dissolve_polygons(own, 1.3)
    assert {r.code: r.component for r in members.collect()} == {"a": "a", "b": "a", "e": "a", "c": "c", "d": "d"}
    found = {r.component: (r.n, round(r.summed, 9), round(r.dissolved, 9)) for r in G.dissolve_summary(own, members, borders, 1.3).collect()}
    assert found == {"a": (3, 8.0625, 7.0), "c": (1, 2.0, 2.0), "d": (1, 1.0, 1.0)}


@pytest.mark.parametrize("tile", [0.9, 7.0])
def test_clip_of_features_and_lines(spark, tile):
    shapes, area = {"b": [U], "a": [HOLED], "c": [STAR], "far": [square(90, 90, 91, 91)]}, {"z": [STAR, square(0, 0, 2, 2)]}
    vertices = layer(spark, shapes)
    measures, border = G.clip_features(vertices.unionByName(vertices.where("code = 'b'")), layer(spark, area), tile)
    found = {r.code: (round(r.source, 6), r.clipped) for r in measures.collect()}
    assert {c: v[0] for c, v in found.items()} == {"b": 24.0, "a": 32.0, "c": 24.5}
    n, union = 200, area["z"]
    for c, (_, clipped) in found.items():
        hits = sum(any(odd(rings, x, y) for rings in shapes[c]) and any(odd(rings, x, y) for rings in union) for i in range(n) for j in range(n) for x, y in [((i + 0.5) * 10 / n, (j + 0.5) * 10 / n)])
        assert clipped == pytest.approx(hits * (10 / n) ** 2, abs=0.2)
    # what comes back is geometry: the clipped feature clipped again is itself
    again = P.area(P.clip(border, P.boundary(sides(spark, area), ["code"], tile).drop("code"), tile, "code"), "code")
    assert {r.code: round(r.area, 6) for r in again.collect()} == {c: round(v[1], 6) for c, v in found.items()}
    lines = spark.createDataFrame([(1, -1.0, 3.0, 11.0, 3.0), (2, 0.0, 0.5, 10.0, 0.5), (3, 50.0, 0.0, 60.0, 0.0)], "line int, x0 double, y0 double, x1 double, y1 double")
    cut = {r.line: (r.source, round(r.clipped, 6)) for r in G.clip_lines(lines, layer(spark, area), tile, "line")[0].collect()}
    assert cut == {1: (12.0, 5.0), 2: (10.0, 2.0)}


def test_coverage_counts_overlapping_features_once(spark):
    regions = sides(spark, {"r1": [square(0, 0, 2, 2)], "r2": [square(2, 0, 4, 2)], "r3": [square(8, 8, 9, 9)]})
    features = sides(spark, {"f": [square(0, 0, 1, 2)], "g": [square(0.5, 0, 3, 2)], "h": [square(0, 0, 4, 1)]}).withColumn("source", F.when(F.col("code") == "h", "y").otherwise("x"))
    found = {r.code: (round(r.x, 9), round(r.y, 9), r.none) for r in G.union_coverage(regions, features, 0.7, ["x", "y", "none"]).collect()}
    assert found == {"r1": (1.0, 0.5, 0.0), "r2": (0.5, 0.5, 0.0), "r3": (0.0, 0.0, 0.0)}


def test_ring_faults_and_quality(spark):
    bow = [[(0, 0), (2, 2), (2, 0), (0, 2)]]  # its signed area cancels
    uneven = [[(10, 0), (12, 2.2), (12, 0), (10, 2)]]
    good = {"u": [U], "star": [STAR], "bow": [bow], "uneven": [uneven], "short": [[[(5, 5), (6, 6)]]], "level": [[[(7, 7), (8, 7), (9, 7)]]], "again": [U]}
    rows = layer(spark, good).unionByName(spark.createDataFrame([("gone", 0, 0, k, None if k == 1 else float(k), float(k * k)) for k in range(4)], "code string, part int, ring int, seq int, x double, y double"))
    assert {r.code: r.reason for r in G.ring_faults(rows, 0.8).collect()} == {"bow": "crossing", "uneven": "crossing", "short": "short", "level": "crossing", "gone": "null"}
    assert tuple(G.geometry_quality(rows, 0.8).first()) == (8, 1, 1, 3, 1)


def test_rows_grow_with_the_sides(spark):
    """A polygon costs rows in proportion to its sides and tiles, not to their product."""
    tile = 0.7  # some 650 tiles
    rows = {n: (P.dealt(own, tile).count(), P.pieces(own, ["code"], tile).count(), P.corners(own, ["code"], tile).count()) for n in (1000, 8000) for own in [sides(spark, {"w": [wheel(n)]})]}
    assert rows[8000][0] < 8000 + 3 * 400 and rows[8000][1] < 8000 + 3 * 800
    assert rows[1000][2] == rows[8000][2] < 800
    area = P.area(sides(spark, {"w": [wheel(8000)]}), "code").first().area
    whole = P.shared_area(sides(spark, {"w": [wheel(8000)]}).withColumnRenamed("code", "l"), sides(spark, {"b": [square(-20, -20, 20, 20)]}).withColumnRenamed("code", "r"), tile, "l", "r").first().area
    assert whole == pytest.approx(area, rel=1e-9)


def test_empty_layers(spark):
    none = sides(spark, {"u": [U]}).where("code = 'x'")
    assert P.boundary(none, ["code"], 1.0).count() == 0 and P.clip(none, sides(spark, {"u": [U]}).drop("code"), 1.0, "code").count() == 0
    assert G.overlay_polygons(none, none, 1.0).count() == 0
