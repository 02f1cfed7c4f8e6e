"""Copies and nested rows: joins must not pair them all."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import components
from gridloom.operators import geometry as S


def test_dissolve_links_corners_not_copies(spark, monkeypatch):
    rng = random.Random(5)
    rects = [(k, float(rng.randrange(40)), float(rng.randrange(40)), rng.choice([0.0, 0.5, 1.0, 1.5]), rng.choice([0.5, 1.0, 1.25])) for k in range(300)]
    rects = [(k, x, y, x + a, y + b) for k, x, y, a, b in rects] + [(1000 + k, 100.0, 100.0, 101.0 + k % 7, 101.0 + k % 7 / 2) for k in range(700)] + [(2000, None, 1.0, 2.0, 2.0)]
    pairs = []
    plain = components.connected_components
    monkeypatch.setattr(components, "connected_components", lambda links, *a: pairs.append(links.count()) or plain(links, *a))
    found = {r.component: r for r in S.dissolve(spark.createDataFrame(rects, "id int, xmin double, ymin double, xmax double, ymax double"), 3.0, "id").collect()}
    top = {k: k for k, *_ in rects}

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    full = [r for r in rects[:300] if r[3] > r[1]]
    for k, x, y, a, b in full:
        for q, u, v, c, d in full:
            if min(a, c) > max(x, u) and min(b, d) > max(y, v):
                one, two = sorted((root(k), root(q)))
                top[two] = one
    want = {}
    for k, x, y, a, b in rects[:300]:
        n, s = want.get(root(k), (0, 0.0))
        want[root(k)] = (n + 1, s + (a - x) * (b - y))
    assert {k: r.n for k, r in found.items()} == {k: n for k, (n, _) in want.items()} | {1000: 700, 2000: 1}
    assert all(found[k].summed == pytest.approx(s) for k, (_, s) in want.items())
    assert found[1000].dissolved == pytest.approx(7 * 4.0)
    assert pairs[0] < 1000  # 244,650 pairs of copies alone before


def test_nearest_hub_looks_up_places_not_points(spark, monkeypatch):
    from gridloom import session

    points = [(k, k % 2, float(k % 10), float(k % 20)) for k in range(2000)]
    hubs = [(g, f"h{k:03}", float(k % 5), 3.0) for g in (0, 1) for k in range(100)]
    rows, plain = [], session.materialize
    monkeypatch.setattr(session, "materialize", lambda df, name: (lambda out: rows.append((name, out.count())) or out)(plain(df, name)))
    out = S.nearest_in_group(spark.createDataFrame(points, "id int, g int, x double, y double"), spark.createDataFrame(hubs, "g int, hub string, x double, y double"), "g", "id", "hub").collect()
    assert max(n for _, n in rows) <= 20  # 2,000 before
    found = {r.id: (r.hub, r.distance) for r in out}
    for k, _, x, y in points:
        d, h = min((((x - a) ** 2 + (y - b) ** 2) ** 0.5, h) for g, h, a, b in hubs if g == 0)
        assert found[k] == (h, pytest.approx(d))


@pytest.mark.parametrize("name", ["dem5_catchments", "dem6_audit", "dem8_allocation", "dem9_conservation"])
def test_assignment_makes_no_pairs_of_a_jurisdiction(spark, sf_dir, monkeypatch, name):
    from gridloom.plans import adapters, catalog

    monkeypatch.setitem(adapters.ADAPTERS, "assigned", "SELECT no_such_column FROM {nation}")
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_line_items_are_joined_once(spark, sf_dir):
    from gridloom.plans import adapters
    from gridloom.plans.adapters import PLACED, Tables, columns

    plain, once = Tables(spark, sf_dir), Tables(spark, sf_dir, columns("SELECT * FROM {net_capacity}"))
    for name in ("net_capacity", "built_capacity", "net_capacity"):
        df = once(name)
        assert not any("lineitem.parquet" in f for f in df.inputFiles())
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, plain(name).collect()))
    assert once.held < set(PLACED) and "price" not in once.held
    # a column that wasn't kept: all are
    assert once("cost_invest").count() == plain("cost_invest").count() and once.held == set(PLACED)
    rows = lambda df: sorted(map(tuple, df.select(*PLACED).collect()))
    assert rows(once("placed")) == rows(plain("placed"))
    assert adapters.uses("SELECT * FROM {net_capacity} JOIN {flow_out}") == 2 and adapters.uses("SELECT * FROM {orders}") == 0


def test_union_of_copied_boxes(spark):
    from gridloom.operators import polygons as G

    boxes = [(f"{k}", "a", float(k % 3), 0.0, k % 3 + 1.0 + k % 5, 1.0 + k % 5 / 2) for k in range(60)]
    rows = [(c, s, *e) for c, s, x, y, a, b in boxes for e in ((x, y, a, y), (a, y, a, b), (a, b, x, b), (x, b, x, y))]
    rows += [("t", "a", 0.0, 0.0, 1.0, 0.0), ("t", "a", 1.0, 0.0, 0.0, 1.0), ("t", "a", 0.0, 1.0, 0.0, 0.0)]
    out = G.outer_boxes(spark.createDataFrame(rows, "code string, source string, x0 double, y0 double, x1 double, y1 double"), ["source"])
    assert {(r.x0, r.y0, r.x1, r.y1) for r in out.collect()} >= {(2.0, 0.0, 7.0, 0.0), (1.0, 0.0, 0.0, 1.0)} and out.count() == 15


def test_customers_meet_orders_not_line_items(spark, sf_dir, monkeypatch):
    from gridloom.plans import adapters
    from gridloom.plans.adapters import Tables, columns

    written, plain = [], adapters.materialize
    monkeypatch.setattr(adapters, "materialize", lambda df, name: written.append(df) or plain(df, name))
    Tables(spark, sf_dir, columns("SELECT * FROM {net_capacity}"))("net_capacity")
    node, depth = written[0]._jdf.queryExecution().optimizedPlan(), []
    # every join with the tables below it
    todo = [node]
    while todo:
        at = todo.pop()
        kids = at.children()
        todo += [kids.apply(k) for k in range(kids.size())]
        if at.nodeName() == "Join":
            leaves = at.collectLeaves()
            depth.append({leaves.apply(k).toString().split("[", 1)[1].split("_", 1)[0] for k in range(leaves.size())})
    assert {"o", "c"} in depth and {"l", "s", "p"} in depth and max(map(len, depth)) == 5
    assert not any({"l", "o"} <= d and len(d) < 5 for d in depth)  # line items went on to customers, suppliers and parts after their orders before
