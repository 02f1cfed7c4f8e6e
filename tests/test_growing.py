"""Nearest hubs, gaps, medians, tweaks by mask and orphan pruning against brute force."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from gridloom.operators import checks, graph, scenarios
from gridloom.operators import geometry as S
from gridloom.operators.joins import distributed_median, gaps
from gridloom.operators.results import grid_spacing


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_hub_by_growing_tiles(spark):
    rng = random.Random(1)
    hubs = [(g, f"h{g}-{k}", x, y) for g in range(4) for k in range([1, 2, 40, 90][g]) for x, y in [(rng.uniform(0, 10) if g < 3 else rng.choice([0.0, 1000.0]) + rng.random(), rng.uniform(0, 10))]]
    hubs += [(5, "line-a", 1.0, 0.0), (5, "line-b", 3.0, 0.0), (6, "gone", None, 1.0)]
    points = [(k, rng.choice([0, 1, 2, 3, 5, 6, 7]), rng.uniform(-500, 1500), rng.uniform(-20, 30)) for k in range(400)] + [(900, 5, 2.0, 0.0), (901, 2, None, 0.0)]
    found = {r.id: (r.hub, r.distance) for r in S.nearest_in_group(spark.createDataFrame(points, "id int, g int, x double, y double"), spark.createDataFrame(hubs, "g int, hub string, x double, y double"), "g", "id", "hub").collect()}
    want = {}
    for k, g, x, y in points:
        own = [(math.sqrt((x - a) ** 2 + (y - b) ** 2), h) for q, h, a, b in hubs if q == g and a is not None and x is not None]
        if own:
            want[k] = min(own)[::-1]
    assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in want.items()}
    assert found[900] == ("line-a", 1.0) and all(found[k][1] == pytest.approx(want[k][1]) for k in want)


def test_gaps_and_medians_by_ranges(spark):
    rng = random.Random(2)
    for n in (0, 1, 2, 7, 500):
        values = [rng.choice([rng.uniform(0, 9), float(rng.randint(0, 9))]) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        assert distributed_median(df, "v").first().median == (pytest.approx(statistics.median(values)) if values else None)
        own = sorted(set(values))
        assert sorted(r.gap for r in gaps(df, "v").collect()) == pytest.approx(sorted(b - a for a, b in zip(own, own[1:], strict=False)))
    points = spark.createDataFrame([(float(x), float(3 * y)) for x in (0, 1, 2, 5) for y in (0, 1, 2)] + [(None, None)], "lon double, lat double")
    assert grid_spacing(points).first().spacing == 1.0


def test_tweaks_join_by_equality(spark):
    base = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0), (None, "x", 4.0)], "r string, t string, v double")
    tweaks = spark.createDataFrame([(1, 1, "a", 10.0, "*", "x"), (1, 2, "r", 1.0, "a", "*"), (2, 3, "s", 7.0, "b", "x"), (2, 4, "s", 7.0, "b", "z"), (3, 5, "a", 1.0, "*", "*")], "run int, seq int, mod string, value double, i0 string, i1 string")
    out = scenarios.apply_tweaks(base, tweaks, ["r", "t"], "v")
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(
        [(1, "a", "x", 1.0, 22.0), (1, "a", "y", 2.0, 4.0), (1, "b", "x", 3.0, 13.0), (1, None, "x", 4.0, 14.0), (2, "b", "x", 3.0, 7.0), (3, "a", "x", 1.0, 2.0), (3, "a", "y", 2.0, 3.0), (3, "b", "x", 3.0, 4.0), (3, None, "x", 4.0, 5.0)], key=repr
    )
    assert [tuple(r) for r in scenarios.unmatched_tweaks(base, tweaks, ["r", "t"]).collect()] == [(2, 4)]
    assert scenarios.apply_tweaks(base, tweaks.limit(0), ["r", "t"], "v").count() == 0
    for df in (out, scenarios.unmatched_tweaks(base, tweaks, ["r", "t"])):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def plain_orphans(links, sources, demands):
    def reach(edges, start):
        seen, todo = set(start), list(start)
        while todo:
            at = todo.pop()
            for a, b in edges:
                if a == at and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    out = {}
    for key in {(r, p) for r, p, *_ in links}:
        own = [x for x in links if x[:2] == key]
        back = reach([((o), i) for *_, i, o in own], demands.get(key, ()))
        side = [x for x in own if x[-1] in back]
        fore = reach([(i, o) for *_, i, o in side], sources.get(key, ()))
        out |= {x: "other" if x[-1] not in back else "demand_side" for x in own if x[-1] not in back or x[-2] not in fore}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_orphans_and_pruning_on_cycles(spark, seed):
    rng = random.Random(seed)
    links = sorted({(f"R{rng.randrange(2)}", rng.randrange(2), f"t{rng.randrange(25)}", 0, f"c{rng.randrange(14)}", f"c{rng.randrange(14)}") for _ in range(60)})
    keys = {x[:2] for x in links}
    sources, demands = dict.fromkeys(keys, ("c0", "c1")), dict.fromkeys(keys, ("c12", "c13"))
    frame = lambda ends: spark.createDataFrame([(r, p, c) for (r, p), own in ends.items() for c in own], "region string, period int, commodity string")
    df = spark.createDataFrame([(r, p, i, t, v, o) for r, p, t, v, i, o in links] * 2, "region string, period int, input_comm string, tech string, vintage int, output_comm string")
    order = lambda r: (r.region, r.period, r.tech, r.vintage, r.input_comm, r.output_comm)
    assert {order(r): r["class"] for r in graph.orphans(df, frame(sources), frame(demands)).collect()} == plain_orphans(links, sources, demands)
    kept, report = graph.prune_orphans(df, frame(sources), frame(demands))
    current, want, k = links, set(), 1
    while bad := plain_orphans(current, sources, demands):
        want |= {(x, c, k) for x, c in bad.items()}
        gone = {(x[0], x[2], x[3]) for x in bad}
        current, k = [x for x in current if (x[0], x[2], x[3]) not in gone], k + 1
    assert sorted(order(r) for r in kept.collect()) == current
    assert {(order(r), r["class"], r["round"]) for r in report.collect()} == want


def test_topology_verdicts_both_ways(spark):
    region = spark.createDataFrame([("A",), ("B",), ("C",), ("C",)], "region string")
    edges = spark.createDataFrame([("A-B", "A", "B", 3.0), ("B-A", "B", "A", 3.0), ("A-C", "A", "C", 5.0)], "edge_region string, region_from string, region_to string, distance_km double")
    roads = edges.select("edge_region", "distance_km", (F.col("edge_region") == "A-C").alias("connected"))
    m = checks.topology(region, region, edges, roads, edges)
    found = {r.metric: r.value for r in m.collect()}
    assert (found["graph_nodes"], found["graph_node_unique_regions"], found["one_way_edges"], found["isolated_nodes"], found["linked_components"], found["road_edge_distance_max"], found["road_connected_rows"]) == (4, 3, 1, 0, 1, 5.0, 1)
    passed = {r.name: r.passed for r in checks.topology_verdicts(m).collect()}
    assert passed == {"basemap has regions": True, "nodes are unique by region": False, "graph has edges": True, "road connections have rows": True, "connected rows exist": True, "road geometries exist": True}
    none = checks.topology_verdicts(checks.topology(region.limit(0), region.limit(0), edges.limit(0), roads.limit(0), edges.limit(0)))
    assert not any(r.passed for r in none.collect())
