"""Queries cover their whole tables: counts against brute force on the smallest ones."""

from collections import Counter, defaultdict
from fractions import Fraction as N

from pyspark.sql import functions as F

from gridloom.operators import graph
from gridloom.plans import catalog
from gridloom.plans.adapters import Tables
from tests.conftest import SF


def test_roads_cover_every_segment_and_cell(spark):
    t = Tables(spark, SF)
    cells = {(r.ix, r.iy): r.region for r in t("cells").collect()}
    crossings, roads = Counter(), defaultdict(set)
    for s in t("segments").collect():
        x0, y0, x1, y1 = (N(round(v * 100), 500) for v in (s.x0, s.y0, s.x1, s.y1))
        cuts = {N(0), N(1)}
        for a, b in ((x0, x1), (y0, y1)):
            if a != b:
                cuts |= {u for k in range(int(min(a, b)) - 2, int(max(a, b)) + 3) if 0 <= (u := (k - a) / (b - a)) <= 1}
        cuts = sorted(cuts)
        at = lambda u: (x0 + u * (x1 - x0), y0 + u * (y1 - y0))
        own = {(p[0] // 1, p[1] // 1) for p in map(at, cuts + [(u + v) / 2 for u, v in zip(cuts, cuts[1:], strict=False)])}
        # at a corner or border the lower cell counts too, if the segment reaches past it elsewhere
        for x, y in map(at, cuts):
            for i in {x // 1, -(-x // 1) - 1}:
                for j in {y // 1, -(-y // 1) - 1}:
                    if i <= x <= i + 1 and j <= y <= j + 1 and i >= min(x0, x1) // 1 and j >= min(y0, y1) // 1:
                        own.add((i, j))
        for i, j in own:
            if (region := cells.get((i + 29, j - 8))) is not None:
                crossings[region] += 1
                roads[region].add(s.segment_id // 4)
    found = {r.region: (r.n_crossings, r.n_roads, r.has_road) for r in catalog.QUERIES["grf15_road_presence"](spark, SF).collect()}
    assert found == {region: (crossings[region], len(roads[region]), crossings[region] > 0) for region in cells.values()}
    for r in catalog.QUERIES["grf17_strong_connection"](spark, SF).collect():
        assert r.n_shared == len(roads[r.region_from] & roads[r.region_to])
    for r, e in ((r, r.edge_region.split("-")) for r in catalog.QUERIES["grf16_weak_connection"](spark, SF).collect()):
        assert r.connected == (e[0] in roads and e[1] in roads)


def test_ramps_of_every_region(spark):
    audited = catalog.QUERIES["lim14_ramp"](spark, SF).select("region").distinct().count()
    assert audited == Tables(spark, SF)("net_capacity").select("region").distinct().count()


def test_every_curve_on_every_edge(spark):
    t, out = Tables(spark, SF), catalog.QUERIES["cst10_expand"](spark, SF)
    assert out.select("tech").distinct().count() == catalog.QUERIES["cst7_template"](spark, SF).select("tech").distinct().count()
    assert out.select("edge_region").distinct().count() == t("edges").count()


def test_links_crosswalk_and_dissolve_read_all_parts(spark):
    t = Tables(spark, SF)
    parts = t("part").count()
    assert catalog.QUERIES["geo10_dissolve"](spark, SF).agg(F.sum("n")).first()[0] == parts
    cells = t("cells").groupBy("ix").count().withColumnRenamed("count", "k")
    want = t("part").join(cells, F.col("ix") == F.col("p_partkey") % 19).agg(F.sum("k")).first()[0]
    assert t("crosswalk").count() == want
    from gridloom.plans.queries_space import _LINKS

    keys = t("part").selectExpr("p_size % 3", "p_partkey % 23", "p_brand", "(p_partkey % 23 * 3 + p_size % 5) % 29").distinct().count()
    assert t.sql(_LINKS).count() == keys


def test_canonical_links(spark):
    nodes = spark.createDataFrame([("A",), ("B",), ("A",)], "region string")
    edges = spark.createDataFrame([("A-B",), ("B-A",), ("A-B",)], "edge_region string")
    roads = spark.createDataFrame([("A-B", True), ("A-B", True), ("B-A", False)], "edge_region string, connected boolean")
    found = sorted(tuple(r) for r in graph.canonical_links(nodes, edges, roads).collect())
    assert found == [("node", "A"), ("node", "B"), ("pipeline", "A-B"), ("pipeline", "B-A"), ("truck", "A-B")]
