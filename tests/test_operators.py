"""Operators on small literal rows with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom.operators import checks, costs, demand, derive, finance, geometry, graph, limits, prepare, regions, results, scenarios
from gridloom.operators.components import connected_components
from gridloom.operators.joins import ContractError, checked_join


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_checked_join(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"), spark.createDataFrame([(1, "p"), (1, "q")], "k int, y string")
    assert checked_join(a, b, ["k"], cardinality="1:m").count() == 2
    with pytest.raises(ContractError):
        checked_join(a, b, ["k"], cardinality="1:1")
    with pytest.raises(ContractError):
        checked_join(a, b.dropDuplicates(["k"]), ["k"], required=True)


def test_components(spark):
    rng = __import__("random").Random(0)
    path = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300), (300, 100)]
    star = [(1000, 1001 + i) for i in range(50)]
    links = path + star + [(5, 5), (None, 3)]
    rng.shuffle(links)
    got = dict(rows(connected_components(spark.createDataFrame(links, "a long, b long")), "node", "component"))
    want = {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100} | {1000 + i: 1000 for i in range(51)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bands(spark):
    values = [0.0, 156.9, 157.0, 703.0, 703.1, 1199.0, 1199.1, 2000.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    bands = spark.createDataFrame([(0.0, None, 157.0, True, False), (0.11, 157.0, 703.0, True, True), (0.43, 703.0, 1199.0, False, True), (0.82, 1199.0, None, False, True)], "band double, lower double, upper double, lower_inclusive boolean, upper_inclusive boolean")
    out = prepare.classify_bands(df, bands, "v", ["i"]).orderBy("i").collect()
    assert [r.band for r in out] == [0, 0, 0.11, 0.11, 0.43, 0.43, 0.82, 0.82, 0]
    with pytest.raises(ContractError):
        prepare.classify_bands(df, bands.where("band > 0"), "v", ["i"])


def test_padding_and_modes(spark):
    df = spark.createDataFrame([("7",), ("1234567",), (None,)], "x string")
    assert [r[0] for r in df.select(prepare.padded("x", 4)).collect()] == ["0007", "1234567", None]
    t = spark.createDataFrame([("H2_PIPE",), ("H2_TRUCK",), ("ELC_TRANS",), ("X",)], "tech string")
    assert [r[0] for r in t.select(prepare.transport_mode()).collect()] == ["pipeline", "truck", "power_line", None]


def test_loan_costs(spark):
    lit = F.lit
    one = finance.loan_cost(lit(100_000.0), lit(1.0), lit(0.1), lit(40), lit(0.0), lit(40), lit(2020), lit(2100), lit(2020))
    two = finance.loan_cost(lit(100_000.0), lit(1.0), lit(0.08), lit(40), lit(0.05), lit(50), lit(2020), lit(2035), lit(2030))
    r = spark.range(1).select(*one, *two).first()
    assert r[0] == pytest.approx(409_037.657, abs=0.01) and r[1] == pytest.approx(409_037.657, abs=0.01)
    assert r[2] == pytest.approx(20_950.21, rel=1e-3) and r[3] == pytest.approx(33_544.06, rel=1e-3)


@pytest.mark.parametrize(("costs_", "want"), [([("A-B", 300.0), ("B-A", 100.0)], {"A": 100.0, "B": 300.0}), ([("A-B", 100.0)], {"A": 40.0, "B": 60.0})])
def test_exchange_costs(spark, costs_, want):
    c = spark.createDataFrame([(link, 2020, "t", 2020, v) for link, v in costs_], "link string, period int, tech string, vintage int, cost double")
    f = spark.createDataFrame([("A-B", 2020, "t", 2020, 60.0), ("B-A", 2020, "t", 2020, 40.0)], "region string, period int, tech string, vintage int, flow double")
    assert dict(rows(results.exchange_costs(c, f), "region", "cost")) == pytest.approx(want)


def flows(spark, *own):
    return spark.createDataFrame([("s", r, 2020, "S", "T", i, t, 2020, o, float(v)) for r, i, t, o, v in own], "scenario string, region string, period int, season string, tod string, input_comm string, tech string, vintage int, output_comm string, flow double")


def test_node_balance(spark):
    need = spark.createDataFrame([("A", 2020, "heat", 10.0)], "region string, period int, commodity string, demand double")
    out = results.node_balance(flows(spark, ("A", "gas", "boiler", "heat", 10)), flows(spark).where("false"), need)
    assert rows(out, "region", "commodity", "production", "demand", "residual") == [("A", "heat", 10.0, 10.0, 0.0)]
    flags = spark.createDataFrame([("heat", "d")], "name string, flag string")
    assert not results.balance_verdict(out, flags, ["s"], 1e-3, 1e-3).first().failed


def test_edge_flow_capacity(spark):
    cap = spark.createDataFrame([("s", "A-B", 2020, "pipe", 2020, 5.0)], "scenario string, region string, period int, tech string, vintage int, capacity double")
    f = flows(spark, ("A-B", "gas", "pipe", "gas", 10))
    assert results.edge_flow_capacity(f, cap).count() == 0
    assert results.edge_flow_capacity(f, cap, strict=True).first().reason == "exceeds"


def test_objective_convention(spark):
    cost = spark.createDataFrame([("s", 60.0, 20.0, 10.0, 10.0, 100.0, 50.0, 25.0, 25.0)], "scenario string, d_invest double, d_fixed double, d_var double, d_emiss double, invest double, fixed double, var double, emiss double")
    label = lambda v: results.reconcile_objective(spark.createDataFrame([("s", v)], "scenario string, total_system_cost double"), cost).first().convention
    assert (label(100.0), label(200.0), label(150.0)) == ("discounted", "raw", "neither")


def test_numeric_rules(spark):
    df = spark.createDataFrame([("a", None), ("b", "x"), ("c", "Infinity"), ("d", "-1"), ("e", "2")], "k string, v string")
    assert rows(checks.numeric_problems(df, {"v": "nonnegative"}, ["k"]), "k", "reason") == [("a", "null"), ("b", "not a number"), ("c", "not finite"), ("d", "negative")]


@pytest.mark.parametrize(("depth", "step", "want"), [(1, 1, [2020, 2025, 2030]), (2, 1, [2020, 2025]), (3, 2, [2020])])
def test_windows(spark, depth, step, want):
    p = spark.createDataFrame([(2020,), (2025,), (2030,), (2035,)], "period int")
    assert [r.base_year for r in derive.windows(p, depth, step).orderBy("base_year").collect()] == want


def test_hubs(spark):
    c = spark.createDataFrame([("h1", "ON", 200.0, 5, 1.0), ("h2", "ON", 50.0, 2, 1.0), ("h3", "NU", 7.0, 1, 2.0), ("h4", "NU", 7.0, 1, 3.0)], "hub_id string, jurisdiction string, population double, class int, area double")
    assert rows(demand.select_hubs(c, 4), "hub_id", "reason") == [("h1", "threshold"), ("h4", "fallback")]


def test_greedy_fill(spark):
    areas = spark.createDataFrame([("X", 1, 100.0, 10.0, 0.0), ("X", 2, 10_000.0, 100.0, 0.0)], "jurisdiction string, area_id int, population double, x double, y double")
    found = spark.createDataFrame([("X", "2", 1.0, 10.0, 0.0), ("X", "3", 1.0, 100.0, 0.0)], "jurisdiction string, hub_id string, population double, x double, y double")
    anchor = spark.createDataFrame([("X", "1", 1.0, 0.0, 0.0)], "jurisdiction string, hub_id string, population double, x double, y double")
    assert rows(demand.greedy_fill(areas, found, anchor, 1), "hub_id") == [("3",)]


def test_allocation_is_conserved(spark):
    parts = spark.createDataFrame([(1, "ON", 75.0), (2, "ON", 25.0), (3, "YT", 10.0)], "id int, j string, population double")
    totals = spark.createDataFrame([("ON", 1000.0), ("YT", 50.0)], "j string, litres double")
    out = demand.allocate(parts, totals, "j", "population", "litres")
    assert rows(out, "id", "litres") == [(1, 750.0), (2, 250.0), (3, 50.0)]
    assert all(r.passed for r in demand.conservation_audit(out, totals, "j", "litres").collect())


def test_line_penalties(spark):
    edges = spark.createDataFrame([("R0-R1", 0.0, 0.0, 2.0, 0.0), ("R2-R3", 0.0, 10.0, 2.0, 10.0)], "edge_id string, x0 double, y0 double, x1 double, y1 double")
    layers = spark.createDataFrame(
        [("water", 9.0, True, 0.0, -1.0, 0.75, 1.0), ("water", 9.0, True, 0.5, -1.0, 1.0, 1.0), ("res", 0.5, False, 1.0, -1.0, 2.0, 1.0), ("res", 0.2, False, -1.0, 9.0, 3.0, 11.0)],
        "layer string, factor double, constant boolean, xmin double, ymin double, xmax double, ymax double",
    )
    out = geometry.line_in_layers(edges, layers, 1.0)
    assert rows(out, "edge_id", "layer", "length", "penalty") == [("R0-R1", "res", 1.0, 0.5), ("R0-R1", "water", 1.0, 9.0), ("R2-R3", "res", 2.0, 0.4)]
    done = graph.cost_distance(edges.withColumnRenamed("edge_id", "edge_region").withColumn("distance_km", F.lit(2.0)), out.withColumnRenamed("edge_id", "edge_region"))
    assert rows(done, "edge_region", "effective_km") == [("R0-R1", 11.5), ("R2-R3", 2.4)]


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(-75.7, 45.4), (-123.1, 49.3), (-91.866666666666667, 63.390675)], "lon double, lat double")
    x, y = geometry.project(F.col("lon"), F.col("lat"))
    p = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    assert p.orderBy(F.abs(F.col("x") - 6_200_000)).first().y == pytest.approx(3_000_000, abs=1e-6)
    lon, lat = geometry.unproject(F.col("x"), F.col("y"))
    for r in p.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert (r.a, r.b) == pytest.approx((r.lon, r.lat), abs=1e-9)


def test_geodesic(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0), (5.0, 50.0, 5.0, 50.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geometry.geodesic_km("a", "b", "c", "d")).collect()]
    assert got == pytest.approx([111.31949, 110.57439, 0.0], abs=1e-4)


def test_source_trace_with_cycle(spark):
    links = spark.createDataFrame([("R", 1, "s", "a"), ("R", 1, "a", "b"), ("R", 1, "b", "a"), ("R", 1, "b", "d"), ("R", 1, "x", "d"), ("R", 1, "b", "y")], "region string, period int, input_comm string, output_comm string")
    ends = lambda c: spark.createDataFrame([("R", 1, c)], "region string, period int, commodity string")
    assert rows(graph.source_trace(links, ends("s"), ends("d")), "input_comm", "output_comm") == [("a", "b"), ("b", "a"), ("b", "d"), ("s", "a")]


def test_region_strings(spark):
    df = spark.createDataFrame([("R1",), ("R1-R2",), ("R1-R1",), ("global",), ("R1+R2",), ("bad name",)], "region string")
    assert [r[0] for r in df.select(checks.region_kind()).collect()] == ["node", "edge", None, "group", "group", None]
    limits_ = spark.createDataFrame([("global", "G"), ("R1+R2", "t1+t2")], "region string, tech_or_group string")
    out = regions.expand_groups(limits_, df.where("region in ('R1')"), spark.createDataFrame([("G", "t9")], "group string, tech string"))
    assert rows(out, "member", "member_tech") == [("R1", "t1"), ("R1", "t2"), ("R1", "t9"), ("R2", "t1"), ("R2", "t2")]


def test_growth_counts_gaps_as_zero(spark):
    cap = spark.createDataFrame([("t", 1, 10.0), ("t", 3, 10.0)], "tech string, period int, capacity double")
    p = spark.createDataFrame([(1,), (2,), (3,)], "period int")
    assert rows(limits.growth_limits(cap, p, ["tech"], "capacity", 0.5, 1.0), "period", "value", "broken") == [(2, 0.0, False), (3, 10.0, True)]


def test_tweaks_in_order(spark):
    base = spark.createDataFrame([("R1", "t", 10.0), ("R2", "t", 20.0)], "region string, tech string, cost double")
    tweaks = spark.createDataFrame([(1, 1, "p", "R1/R2|t", "r", 0.5), (1, 2, "p", "R1|*", "a", 1.0), (2, 1, "p", "*|t", "s", 7.0), (2, 2, "p", "R9|t", "s", 1.0)], "run int, seq int, param string, index string, mod string, value double")
    wide = scenarios.expand_tweaks(tweaks, 2)
    assert rows(scenarios.apply_tweaks(base, wide, ["region", "tech"], "cost"), "run", "region", "old", "new") == [(1, "R1", 10.0, 16.0), (1, "R2", 20.0, 30.0), (2, "R1", 10.0, 7.0), (2, "R2", 20.0, 7.0)]
    assert rows(scenarios.unmatched_tweaks(base, wide, ["region", "tech"]), "run", "seq") == [(2, 2)]


def test_curves(spark):
    c = spark.createDataFrame([("t", 2.0, 0.5, 1.0, 100.0)], "tech string, k double, e double, lo double, hi double")
    seg = costs.piecewise_template(c, ["tech"], 3)
    assert [tuple(round(v, 6) for v in r[2:]) for r in seg.orderBy("segment").collect()] == [(0, 1, 0, 2), (1, 10, 2, round(2 * math.sqrt(10), 6)), (10, 100, round(2 * math.sqrt(10), 6), 20)]
    assert costs.curve_problems(seg, ["tech"]).count() == 0
    points = spark.createDataFrame([("t", x, 3 + 2 * x) for x in (1.0, 2.0, 5.0)], "tech string, x double, y double")
    f = costs.fits(points, ["tech"], "x", "y").first()
    assert (f.a, f.b) == pytest.approx((3, 2))


def test_within_or_nearest(spark):
    p = spark.createDataFrame([("a", 5.0, 5.0), ("b", 11.0, 5.0), ("c", 30.0, 5.0), ("d", 10.0, 10.0)], "point_id string, x double, y double")
    r = spark.createDataFrame([("Z1", 0.0, 0.0, 10.0, 10.0), ("Z0", 10.0, 10.0, 20.0, 20.0)], "code string, xmin double, ymin double, xmax double, ymax double")
    out = geometry.within_or_nearest(p, r, 2.0)
    assert rows(out.na.fill(""), "point_id", "code", "matched_by") == [("a", "Z1", "within"), ("b", "Z1", "nearest"), ("c", "", "none"), ("d", "Z0", "within")]


def test_dissolve(spark):
    boxes = [(1, 0.0, 0.0, 2000.0, 1000.0), (2, 1000.0, 0.0, 3000.0, 1000.0), (3, 3000.0, 0.0, 4000.0, 1000.0), (4, 2500.0, 500.0, 2600.0, 5000.0)]
    out = geometry.dissolve(spark.createDataFrame(boxes, "k long, xmin double, ymin double, xmax double, ymax double"), 700.0, "k")
    assert [(c, n, round(a, 6), round(d, 6)) for c, n, a, d in rows(out, "component", "n", "summed", "dissolved")] == [(1, 3, 4_450_000.0, 3_400_000.0), (3, 1, 1_000_000.0, 1_000_000.0)]
