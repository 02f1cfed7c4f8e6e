"""Emissions of all sources and the fuller limit audits, on literal rows with known answers."""

import pytest

from gridloom.operators import checks, limits, results

LINK = "scenario string, region string, period int, season string, tod string, input_comm string, tech string, vintage int, output_comm string, flow double"


def test_emissions_and_costs(spark):
    """Activity 10 * 0.5; 100 built at 2 a unit over 5 years: 40 a year; 3 a year retired at 4: 12. Costs at rate 0: years times price."""
    flow = spark.createDataFrame([("s", "A", 2000, "S", "D", "i", "t", 2000, "o", 10.0)], LINK)
    key = "region string, emis_comm string, tech string, vintage int"
    activity = spark.createDataFrame([("A", "co2", "t", 2000, "i", "o", 0.5)], f"{key}, input_comm string, output_comm string, activity double")
    built = spark.createDataFrame([("s", "A", "t", 2000, 100.0)], "scenario string, region string, tech string, vintage int, capacity double")
    retired = spark.createDataFrame([("s", "A", "t", 2000, 2005, 3.0)], "scenario string, region string, tech string, vintage int, period int, capacity double")
    rate = lambda v: spark.createDataFrame([("A", "co2", "t", 2000, v)], f"{key}, rate double")
    lengths = spark.createDataFrame([(2000, 5), (2005, 5)], "period int, length int")
    found = results.emissions(flow, activity, built, rate(2.0), retired, rate(4.0), lengths)
    assert {(r.period, r.source): r.emission for r in found.collect()} == {(2000, "activity"): 5.0, (2000, "embodied"): 40.0, (2005, "end of life"): 12.0}
    price = spark.createDataFrame([("A", 2000, "co2", 2.0), ("A", 2005, "co2", 1.0)], "region string, period int, emis_comm string, cost double")
    cost = {r.period: (r.d_emiss, r.emiss) for r in results.emission_costs(found, price, lengths, 0.0, 2000).collect()}
    assert cost == {2000: (450.0, 450.0), 2005: (60.0, 60.0)}
    later = {r.period: r.d_emiss for r in results.emission_costs(found, price, lengths, 0.1, 2000).collect()}
    assert later[2005] == pytest.approx(12 * (1 - 1.1**-5) / 0.1 * 1.1**-5)
    bound = spark.createDataFrame([("A+B", 2000, "co2", "le", 44.0), ("global", 2005, "co2", "ge", 12.0)], "region string, period int, emis_comm string, operator string, bound double")
    regions = spark.createDataFrame([("A",), ("B",)], "region string")
    assert {r.period: (r.emission, r.broken) for r in limits.emission_limits(bound, found, regions).collect()} == {2000: (45.0, True), 2005: (12.0, False)}


def test_storage(spark):
    """One unit of capacity 2 with two slices of half a year each: power 1 a slice, energy 4 h of it a day."""
    store = "scenario string, region string, period int, tech string, vintage int"
    rows = lambda data, columns: spark.createDataFrame([("s", "A", 2000, "b", 1995, *d) for d in data], f"{store}, {columns}")
    capacity = rows([(2.0,)], "capacity double")
    storage = spark.createDataFrame([("b", 12.0, 1.0)], "tech string, duration double, to_activity double")
    slices = spark.createDataFrame([(2000, "S", "D", 0.5), (2000, "S", "N", 0.5)], "period int, season string, tod string, segfrac double")
    sequence = checks.slice_sequence(slices, "season")

    def audit(flows, levels):
        found = limits.storage_audit(rows(flows, "season string, tod string, charge double, discharge double"), rows(levels, "season string, tod string, level double"), capacity, storage, sequence, slices, 1.0)
        return {(r.tod, r.finding) for r in found.collect()}

    good = [("S", "D", 0.8, 0.0), ("S", "N", 0.0, 0.8)]
    assert audit(good, [("S", "D", 0.0), ("S", "N", 0.8)]) == set()
    assert audit(good, [("S", "D", 0.1), ("S", "N", 0.8)]) == {("D", "state"), ("N", "state")}
    assert audit([("S", "D", 1.2, 0.0), ("S", "N", 0.0, 1.2)], [("S", "D", -0.1), ("S", "N", 1.1)]) == {("D", "negative"), ("D", "charge"), ("D", "throughput"), ("N", "discharge"), ("N", "throughput"), ("N", "energy")}


def test_balance_with_waste(spark):
    keys = "scenario string, region string, period int, season string, tod string, commodity string, flow double"
    made = spark.createDataFrame([("s", "A", 1, "S", "D", c, v) for c, v in (("x", 3.0), ("x", 2.0), ("w", 4.0), ("e", 1.0), ("d", 1.0))], keys)
    used = spark.createDataFrame([("s", "A", 1, "S", "D", c, v) for c, v in (("x", 5.0), ("w", 3.0), ("e", 2.0), ("v", 1.0))], keys)
    flags = spark.createDataFrame([("x", "p"), ("w", "w"), ("e", "p"), ("d", "d"), ("v", "w")], "name string, flag string")
    assert {r.commodity: r.broken for r in limits.slice_balance(made, used, flags).collect()} == {"x": False, "w": False, "e": True, "v": True}


def test_linked_output(spark):
    rows = [("s", "A", 2000, "S", tod, i, t, 2000, o, v) for tod, i, t, o, v in (("D", "i", "p", "o", 10.0), ("D", "e", "l", "c", 5.0), ("N", "i", "p", "o", 10.0), ("N", "e", "l", "c", 4.0))]
    activity = spark.createDataFrame([("A", "co2", "p", 2000, "i", "o", -0.5)], "region string, emis_comm string, tech string, vintage int, input_comm string, output_comm string, activity double")
    links = spark.createDataFrame([("A", "p", "co2", "l")], "region string, tech string, emis_comm string, linked_tech string")
    found = limits.linked_output(spark.createDataFrame(rows, LINK), activity, links).collect()
    assert [(r.tod, r.emission, r.flow) for r in found] == [("N", -5.0, 4.0)]


def test_adjusted_capacity(spark):
    """100 built, 10 retired when half survives: 80 left, of which the curve and the life leave 0.4."""
    own = "scenario string, region string, tech string, vintage int"
    built = spark.createDataFrame([("s", "A", "t", 1995, 100.0)], f"{own}, capacity double")
    retired = spark.createDataFrame([("s", "A", "t", 1995, 2000, 10.0)], f"{own}, period int, capacity double")
    net = spark.createDataFrame([("s", "A", "t", 1995, 1995, 100.0), ("s", "A", "t", 1995, 2000, 32.0), ("s", "A", "t", 1995, 2005, 1.0)], f"{own}, period int, capacity double")
    life = spark.createDataFrame([("A", 1995, "t", 1995, 1.0, 1.0), ("A", 2000, "t", 1995, 0.4, 0.5), ("A", 2005, "t", 1995, 0.1, 0.2)], "region string, period int, tech string, vintage int, fraction double, survival double")
    found = {r.period: (r.expected, r.broken) for r in limits.adjusted_capacity(built, retired, net, life).collect()}
    assert found == {1995: (100.0, False), 2000: (32.0, False), 2005: (8.0, True)}


def test_price_checks_exemptions(spark):
    key = "region string, tech string, vintage int"
    efficiency = spark.createDataFrame([("A", t, v) for t, v in (("x", 2000), ("x", 1990), ("free", 2000), ("y", 2000))] + [("B", "y", 2000)], key)
    cost = spark.createDataFrame([("B", "y", 2000, 2000)], f"{key}, period int")
    none = cost.where("false")
    technology = spark.createDataFrame([("x", 0), ("y", 0), ("free", 1)], "tech string, unlim_cap int")
    horizon = spark.createDataFrame([(2000,), (2005,)], "period int")
    found = {(r.region, r.tech, r.vintage, r.finding) for r in checks.price_checks(efficiency, cost, none, none.drop("period"), none, technology, horizon).collect() if r.finding != "no cost"}
    assert found == {("A", "x", 2000, "no fixed or invest cost"), ("A", "y", 2000, "no fixed or invest cost"), ("A", "y", 2000, "fixed cost of the build year only elsewhere")}
