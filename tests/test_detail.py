"""Demand by slice, ramps by the hour, retirement by the year, the whole flow index, supporting tables, naming faults and diagram details on rows with known answers."""

import pytest

from gridloom.operators import checks, costs, derive, limits, results
from gridloom.operators.joins import ContractError

STORE = "scenario string, region string, period int, tech string, vintage int"
LINK = "scenario string, region string, period int, season string, tod string, input_comm string, tech string, vintage int, output_comm string, flow double"


def links(spark, rows):
    return spark.createDataFrame([("s", "A", 2000, season, tod, "i", tech, 2000, out, float(v)) for season, tod, tech, out, v in rows], LINK)


def test_demand_shares(spark):
    """100 a year, shares 0.75 and 0.25 and a slice without one: t keeps them, u makes all by day."""
    flow = links(spark, [("S", "D", "t", "heat", 75), ("S", "N", "t", "heat", 25), ("S", "D", "u", "heat", 40), ("S", "D", "t", "coal", 9)])
    shares = spark.createDataFrame([("A", 2000, "S", "D", "heat", 0.75), ("A", 2000, "S", "N", "heat", 0.25), ("A", 2000, "S", "X", "heat", 0.0), ("B", 2000, "S", "D", "heat", 1.0)], "region string, period int, season string, tod string, commodity string, share double")
    got = {(r.tech, r.tod): (r.flow, r.expected, r.broken) for r in limits.demand_shares(flow, shares).collect()}
    assert got == {("t", "D"): (75.0, 75.0, False), ("t", "N"): (25.0, 25.0, False), ("u", "D"): (40.0, 30.0, True), ("u", "N"): (0.0, 10.0, True)}
    annual = spark.createDataFrame([("s", "A", 2000, "u", 2000, "heat", 40 / 0.75)], f"{STORE}, commodity string, flow double")
    got = {(r.tech, r.tod): r.broken for r in limits.demand_shares(flow, shares, annual).collect()}
    assert got == {("u", "D"): False, ("u", "N"): True}
    edge = flow.replace("A", "C-A", "region")
    assert limits.demand_shares(edge, shares).count() == 4
    assert limits.demand_shares(flow.limit(0), shares).count() == 0


SLICES = [(2000, "S1", "D", 0.3), (2000, "S1", "N", 0.1), (2000, "S2", "D", 0.4), (2000, "S2", "N", 0.2)]


def test_hourly_ramps(spark):
    """Ten days of 24 hours: S1 D has 72 hours, S1 N 24, S2 D 96, S2 N 48. The middles of two slices of a season are 12 hours apart."""
    slices = spark.createDataFrame(SLICES, "period int, season string, tod string, segfrac double")
    flow = links(spark, [("S1", "D", "t", "o", 72), ("S1", "N", "t", "o", 12), ("S2", "D", "t", "o", 192)])
    capacity = spark.createDataFrame([("s", "A", 2000, "t", 2000, 2.0)], f"{STORE}, capacity double")
    rates = spark.createDataFrame([("A", "t", "up", 0.05), ("A", "t", "down", 0.01), ("A", "t", "down", 0.2)], "region string, tech string, direction string, rate double")
    within = limits.hourly_ramps(flow, capacity, checks.slice_sequence(slices, "season"), slices, rates, 10.0, 1.0)
    got = {(r.season, r.tod, r.direction): (pytest.approx(r.change), pytest.approx(r.allowed), r.broken) for r in within.collect()}
    assert got == {  # 0.2 * 12 hours reaches the whole capacity: no row
        ("S1", "D", "up"): (12 / 72 - 1, 1.2, False), ("S1", "D", "down"): (1 - 12 / 72, 0.24, True), ("S1", "N", "up"): (3 - 0.5, 1.2, True), ("S1", "N", "down"): (0.5 - 3, 0.24, False),
        ("S2", "D", "up"): (-2, 1.2, False), ("S2", "D", "down"): (2, 0.24, True), ("S2", "N", "up"): (4, 1.2, True), ("S2", "N", "down"): (-4, 0.24, False),
    }
    own = limits.hourly_ramps(flow, capacity, checks.slice_sequence(slices, "season"), slices, rates, 10.0, 1.0, own_hours=True)
    assert {(r.season, r.tod): pytest.approx(r.change) for r in own.where("direction = 'up'").collect()} == {("S1", "D"): -0.5, ("S1", "N"): 0.5, ("S2", "D"): -2.0, ("S2", "N"): 2.0}
    between = checks.season_sequence(slices)
    assert {tuple(r) for r in between.select("season", "tod", "next_season", "next_tod").collect()} == {("S1", "N", "S2", "D"), ("S2", "N", "S1", "D")}
    got = {(r.season, r.next_season): (pytest.approx(r.change), pytest.approx(r.allowed)) for r in limits.hourly_ramps(flow, capacity, between, slices, rates.where("direction = 'up'"), 10.0, 1.0, True).collect()}
    assert got == {("S1", "S2"): (1.5, 2 * 0.05 * 12 * (0.25 + 2 / 3)), ("S2", "S1"): (1.0, 2 * 0.05 * 12 * (0.75 + 1 / 3))}
    assert checks.season_sequence(slices.where("season = 'S1'")).count() == 0


def plain_retirement(net, existing, lifetime, life, periods, vintage):
    """Start and end of one process by period, read off the definition."""
    last_year, out = vintage + lifetime, {}
    real = periods[:-1]
    for k, p in enumerate(real):
        if not vintage <= p <= last_year:
            continue
        fraction, survival = life[p]
        if p < last_year:
            start = net.get(p, 0) / fraction * survival
        elif k == 0:
            start = existing * survival
        else:
            start = net.get(real[k - 1], 0) / life[real[k - 1]][0] * survival
        n = periods[k + 1]
        if last_year < n:
            end = 0
        elif k == len(real) - 1 or n == last_year:
            end = start * life[n][1] / survival
        else:
            end = net.get(n, 0) / life[n][0] * life[n][1]
        out[p] = (start, end, (start - end) / (n - p))
    return out


def test_annual_retirement(spark):
    periods = [2000, 2005, 2010, 2020, 2025]
    horizon = spark.createDataFrame([(p, n - p if n else None) for p, n in zip(periods, [*periods[1:], None])], "period int, length int")
    life = {2000: (1.0, 1.0), 2005: (0.9, 0.95), 2010: (0.5, 0.8), 2020: (0.4, 0.6), 2025: (1.0, 0.3)}
    cases = {("a", 2000, 10): {2000: 50.0, 2005: 40.0}, ("b", 2000, 7): {2000: 50.0, 2005: 10.0}, ("c", 1990, 10): {}, ("d", 2000, 40): {2000: 9.0, 2005: 8.0, 2010: 7.0, 2020: 6.0}, ("e", 2010, 10): {2010: 4.0}}
    net = spark.createDataFrame([("s", "A", p, t, v, c) for (t, v, _), rows in cases.items() for p, c in rows.items()], f"{STORE}, capacity double")
    existing = spark.createDataFrame([("s", "A", "c", 1990, 20.0)], "scenario string, region string, tech string, vintage int, capacity double")
    lifetime = spark.createDataFrame([("A", t, v, n) for t, v, n in cases], "region string, tech string, vintage int, lifetime int")
    curve = spark.createDataFrame([("A", p, t, v, *life[p]) for t, v, _ in cases for p in periods], "region string, period int, tech string, vintage int, fraction double, survival double")
    got = {(r.tech, r.period): (r.start, r.end, r.retirement) for r in limits.annual_retirement(net, existing, lifetime, curve, horizon).collect()}
    want = {(t, p): pytest.approx(v) for (t, vintage, n), rows in cases.items() for p, v in plain_retirement(rows, 20.0, n, life, periods, vintage).items()}
    assert got == want and got["c", 2000] == (20.0, 0.0, 4.0) and len(got) == 3 + 2 + 1 + 4 + 2
    solved = spark.createDataFrame([("s", "A", 2000, "c", 1990, 4.0)], f"{STORE}, retirement double")
    broken = {(r.tech, r.period): r.broken for r in limits.annual_retirement(net, existing, lifetime, curve, horizon, solved).collect()}
    assert not broken["c", 2000] and broken["b", 2000]
    assert limits.annual_retirement(net.limit(0), existing.limit(0), lifetime, curve, horizon).count() == 0


def test_flow_index(spark):
    own = spark.createDataFrame([("A", t, 2000, 2000) for t in ("slice", "year", "store", "need")], "region string, tech string, vintage int, period int")
    efficiency = spark.createDataFrame([("A", t, 2000, "i", o) for t, o in (("slice", "o"), ("year", "o"), ("store", "o"), ("need", "heat"), ("need", "o"))], "region string, tech string, vintage int, input_comm string, output_comm string")
    flags = spark.createDataFrame([("slice", 0, 1, 1, 0, 0, 0, 0), ("year", 1, 1, 0, 0, 0, 0, 0), ("store", 0, 0, 0, 1, 1, 0, 0), ("need", 0, 0, 0, 0, 0, 1, 1)], "tech string, annual int, flex int, curtail int, storage int, seasonal int, demand int, unlim_cap int")
    slices = spark.createDataFrame([r[:3] for r in SLICES] * 2, "period int, season string, tod string")
    commodity = spark.createDataFrame([("o", "p"), ("heat", "d")], "name string, flag string")
    rows = derive.flow_index(own, efficiency, slices, flags, commodity, slices).collect()
    n = {}
    for r in rows:
        n[r.tech, r.kind] = n.get((r.tech, r.kind), 0) + 1
    assert n == {
        ("slice", "flow"): 4, ("slice", "flex"): 4, ("slice", "curtail"): 4, ("slice", "activity"): 1, ("slice", "capacity"): 1, ("year", "flow_annual"): 1, ("year", "flex_annual"): 1, ("year", "activity"): 1, ("year", "capacity"): 1,
        ("store", "flow"): 4, ("store", "storage_in"): 4, ("store", "storage_level"): 4, ("store", "seasonal_level"): 2, ("store", "activity"): 1, ("store", "capacity"): 1, ("need", "flow"): 8, ("need", "flow_annual"): 1, ("need", "activity"): 1,
    }
    assert {r.output_comm for r in rows if r.tech == "need" and r.kind == "flow_annual"} == {"heat"}
    assert all((r.tod is None) == (r.kind in ("flow_annual", "flex_annual", "activity", "capacity", "seasonal_level")) for r in rows)


def test_encode_static(spark):
    technologies = spark.createDataFrame([("truck", "t", "x"), ("pipe", "q", None)], "tech string, flag string, reserve string")
    tables = lambda required: costs.encode_static(
        technologies, spark.createDataFrame([("gas", "p")], "name string, flag string"), spark.createDataFrame([(t,) for t in required], "tech string"), spark.createDataFrame([(2050,), (2020,), (2050,)], "period int"),
        spark.createDataFrame([("rate", 0.1), ("kept", 7.0)], "element string, value double"), {"rate": 0.03}, {"sector": "industrial", "reserve": 0}, {"t": "transport"},
    )
    got = {name: {tuple(r) for r in df.collect()} for name, df in tables(["truck"]).items()}
    assert got["Technology"] == {("truck", "t", 0, "industrial"), ("pipe", "q", 0, "industrial")} and got["Commodity"] == {("gas", "p")}
    assert got["TechnologyType"] == {("t", "transport"), ("q", None)} and got["SectorLabel"] == {("industrial", "industrial sector")}
    assert got["TimePeriod"] == {(1, 2020, "f"), (2, 2050, "f")} and got["MetaDataReal"] == {("rate", 0.03), ("kept", 7.0)}
    with pytest.raises(ContractError, match="ship"):
        tables(["ship", "truck"])


def test_names(spark):
    regions = spark.createDataFrame([("A",), ("B",), ("C",)], "region string")
    want = {
        "A": ("node", None), "D": ("node", "unknown"), "a b": ("node", "characters"), "A\n": ("node", "characters"), "": ("node", "characters"), "global": ("group", None), "A+B": ("group", None), "A+A": ("group", "repeated"), "A+D": ("group", "unknown"), "A+": ("group", "unknown"),
        "A-B": ("edge", None), "A-A": ("edge", "same ends"), "A-D": ("edge", "unknown"), "A-B-C": ("edge", "characters"), "A+B-C": ("edge", "characters"), "A-": ("edge", "characters"), None: (None, "missing"),
    }
    names = spark.createDataFrame([(n,) for n in want for _ in range(2)], "name string")
    assert {r["name"]: (r.kind, r.finding) for r in checks.name_findings(names, regions).collect()} == want
    assert checks.name_findings(names.limit(0), regions).count() == 0
    assert {r.region for r in checks.reserved_nodes(spark.createDataFrame([("A",), ("global",), ("x-y",)], "region string")).collect()} == {"global", "x-y"}
    table = spark.createDataFrame([("a/b", 1, "c"), ("a/b", 2, "x|y"), (None, 3, "fine")], "tech string, n int, comm string")
    assert {tuple(r) for r in checks.element_findings(table, ["tech", "n", "comm"]).collect()} == {("tech", "a/b", 2), ("comm", "x|y", 1)}
    assert checks.element_findings(table, ["n"]).count() == 0
    entries = spark.createDataFrame([("A", "g", "t"), ("A-D", "g", "t"), ("B", "h", "u"), (None, "g", "t")], "region string, group string, tech string")
    found = checks.group_entry_findings(entries, regions, spark.createDataFrame([("g",)], "group string"), spark.createDataFrame([("t",)], "tech string"))
    assert {(r.region, r.finding) for r in found.collect()} == {("A-D", "region"), ("B", "group"), ("B", "tech"), (None, "region")}


def test_diagram_details(spark):
    made = links(spark, [("S", "D", "t", "o", 3), ("S", "N", "t", "o", 4)])
    taken = links(spark, [("S", "D", "t", "o", 5)]).unionByName(links(spark, [("S", "D", "w", "o", 9)]).replace("i", "ethos", "input_comm"))
    net = spark.createDataFrame([("s", "A", 2000, "t", v, c) for v, c in ((1995, 2.0), (2000, 8.0))], f"{STORE}, capacity double")
    got = {(r.tech, r.vintage, r.kind, r.commodity): r.value for r in results.process_detail(taken, made, net, spark.createDataFrame([("ethos",)], "name string")).collect()}
    assert got == {("t", 2000, "input", "i"): 5.0, ("t", 2000, "output", "o"): 7.0, ("t", 1995, "vintage", None): 2.0, ("t", 2000, "vintage", None): 8.0, ("t", None, "total", None): 10.0}
    could = spark.createDataFrame([("A", t, 2000, i, o) for t, i, o in (("t", "i", "o"), ("x", "i", "z"), ("y", "k", "o"))], "region string, tech string, vintage int, input_comm string, output_comm string")
    got = {(r.commodity, r.tech, r.kind): (r.used, r.value) for r in results.commodity_detail(taken.where("input_comm = 'i'"), made, could).collect()}
    assert got == {("i", "t", "use"): (True, 5.0), ("i", "x", "use"): (False, None), ("o", "t", "make"): (True, 7.0), ("o", "y", "make"): (False, None)}
