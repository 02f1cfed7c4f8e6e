"""Adjacency, impedance, road networks, process networks (GRF-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.joins import first_per_key, union
from gridloom.operators.regions import edge_from, edge_to, is_edge, undirected_key
from gridloom.session import drop_folder, materialize

#: Neighbour offsets; NONE stands for no neighbour.
OFFSETS = (("up", 0, 1), ("down", 0, -1), ("left", -1, 0), ("right", 1, 0))
NONE = "R-999"


def rook_neighbours(cells: DataFrame) -> DataFrame:
    """GRF-1: region, direction, neighbour (R-999 if none) by whole-number offsets of (ix, iy)."""
    steps = F.explode(F.array(*(F.struct(F.lit(n).alias("direction"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for n, dx, dy in OFFSETS))).alias("s")
    wanted = cells.select("region", "ix", "iy", steps).select("region", F.col("s.direction").alias("direction"), (F.col("ix") + F.col("s.dx")).alias("ix"), (F.col("iy") + F.col("s.dy")).alias("iy"))
    return wanted.join(cells.select("ix", "iy", F.col("region").alias("neighbour")), ["ix", "iy"], "left").select("region", "direction", F.coalesce("neighbour", F.lit(NONE)).alias("neighbour"))


def neighbour_counts(neighbours: DataFrame) -> DataFrame:
    """GRF-2: neighbours of each cell; isolated without any."""
    return neighbours.groupBy("region").agg(F.count_if(F.col("neighbour") != NONE).alias("n")).withColumn("isolated", F.col("n") == 0)


def directed_edges(neighbours: DataFrame, cells: DataFrame, distance: Column) -> DataFrame:
    """GRF-3: one row an ordered pair: edge_region, ends, direction, coordinates, distance_km. distance: of cx_from, cy_from, cx_to, cy_to."""
    a, b = (cells.select(F.col("region").alias(f"region_{s}"), F.col("cx").alias(f"cx_{s}"), F.col("cy").alias(f"cy_{s}")) for s in ("from", "to"))
    pairs = neighbours.where(F.col("neighbour") != NONE).select(F.col("region").alias("region_from"), F.col("neighbour").alias("region_to"), "direction")
    return pairs.join(a, "region_from").join(b, "region_to").withColumn("edge_region", F.concat_ws("-", "region_from", "region_to")).withColumn("distance_km", distance)


def graph_contract(cells: DataFrame, constants: Sequence[str]) -> DataFrame:
    """GRF-4: verdicts: unique regions, unique centres, one value in each constant column."""
    row = cells.agg(
        (F.count("*") == F.count_distinct("region")).alias("unique_regions"), (F.count("*") == F.count_distinct("cx", "cy")).alias("unique_centres"), *((F.count_distinct(c) == 1).alias(f"single_{c}") for c in constants)
    )
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("passed")) for c in row.columns))).alias("x")).select("x.*")


def on_first_edge(edges: DataFrame, compute, edge: str = "edge_region") -> DataFrame:
    """GRF-5: compute(df) on one edge of each undirected pair; its new columns go to both directions."""
    keyed = edges.withColumn("undirected", undirected_key(edge))
    firsts = first_per_key(keyed, ["undirected"], edge)
    done = compute(firsts)
    new = [c for c in done.columns if c not in keyed.columns]
    return keyed.join(done.select("undirected", *new), "undirected")


def cost_distance(edges: DataFrame, penalties: DataFrame, key: str = "edge_region", physical: str = "distance_km") -> DataFrame:
    """GRF-6: effective distance (physical plus penalties), multiplier and penalty share."""
    total = penalties.groupBy(key).agg(F.sum("penalty").alias("penalty"))
    out = edges.join(total, key, "left").na.fill(0.0, ["penalty"])
    out = out.withColumn("effective_km", F.col(physical) + F.col("penalty"))
    return out.withColumns({"multiplier": F.col("effective_km") / F.col(physical), "penalty_share": F.col("penalty") / F.col("effective_km")})


def impedance_summary(edges: DataFrame, *keys: str, penalties: DataFrame | None = None, layers: Sequence[str] = (), edge: str = "edge_region") -> DataFrame:
    """GRF-7: per graph: edges, distance sums, mean and largest multiplier, penalised edges, and for each layer the sum of its penalties as `<layer>_km`.

    penalties: edge, layer, penalty; an edge may have several rows of a layer. Layers that an edge doesn't meet add 0.
    """
    wide = edges
    if layers:
        sums = penalties.groupBy(edge).pivot("layer", list(layers)).agg(F.sum("penalty"))
        wide = edges.join(sums.select(edge, *(F.col(f"`{n}`").alias(f"_{n}") for n in layers)), edge, "left")
    return wide.groupBy(*keys).agg(
        F.count("*").alias("n_edges"), F.sum("distance_km").alias("physical_km"), F.sum("effective_km").alias("effective_km"), F.avg("multiplier").alias("mean_multiplier"), F.max("multiplier").alias("max_multiplier"), F.count_if(F.col("penalty") > 0).alias("n_penalised"),
        *(F.coalesce(F.sum(f"`_{n}`"), F.lit(0.0)).alias(f"{n}_km") for n in layers),
    )


#: Which cost kinds take the effective distance in each scope.
SCOPES = {"none": (), "etl_capex_only": ("capex",), "all_km_dependent": ("capex", "fixed", "variable")}


def scoped_distances(edges: DataFrame, scope: str) -> DataFrame:
    """GRF-8: capex_km, fixed_km and variable_km: effective where the scope says so, else physical."""
    return edges.withColumns({f"{k}_km": F.col("effective_km" if k in SCOPES[scope] else "distance_km") for k in ("capex", "fixed", "variable")})


def coverage(edges: DataFrame, impedance: DataFrame, key: str = "edge_region") -> DataFrame:
    """GRF-8: edges that only one of the two tables has."""
    both = edges.select(key, F.lit(True).alias("a")).join(impedance.select(key, F.lit(True).alias("b")), key, "full")
    return both.where("a is null or b is null").select(key, F.when(F.col("a").isNull(), "extra").otherwise("missing").alias("reason"))


def network_classes(segments: DataFrame, classes: DataFrame) -> DataFrame:
    """GRF-10: segments of each network by its list of classes(network, class)."""
    return segments.join(classes, "class")


def unique_geometry(segments: DataFrame, geometry: Sequence[str], *order: Column | str) -> DataFrame:
    """GRF-11: of equal geometries the first in the given order."""
    return first_per_key(segments, geometry, *order)


def geometry_quality(segments: DataFrame, geometry: Sequence[str]) -> DataFrame:
    """GRF-12: rows, null and empty (zero length) geometries, and repeats."""
    null = F.greatest(*(F.col(c).isNull().cast("int") for c in geometry)) == 1
    x0, y0, x1, y1 = geometry
    return segments.agg(F.count("*").alias("n"), F.count_if(null).alias("n_null"), F.count_if((F.col(x0) == F.col(x1)) & (F.col(y0) == F.col(y1))).alias("n_empty"), (F.count("*") - F.count_distinct(F.struct(*geometry))).alias("n_repeated"))


def class_counts(segments: DataFrame, group: str, of: str) -> DataFrame:
    """GRF-13: segments of each class per jurisdiction, the largest first; null classes and groups are values."""
    return segments.groupBy(group, of).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group, of)


def network_summary(segments: DataFrame, group: str, flags: Sequence[str], total: str = "STUDY_AREA") -> DataFrame:
    """GRF-14: segments, and for each flag the kept ones and their percent (one decimal), per group and for all."""
    cols = [c for f in flags for c in (F.count_if(F.col(f)).alias(f), F.round(100 * F.count_if(F.col(f)) / F.count("*"), 1).alias(f"{f}_pct"))]
    return segments.rollup(group).agg(F.grouping(group).alias("_g"), F.count("*").alias("n"), *cols).withColumn(group, F.when(F.col("_g") == 1, total).otherwise(F.col(group).cast("string"))).drop("_g")


def road_presence(regions: DataFrame, road_cells: DataFrame) -> DataFrame:
    """GRF-15: distinct roads and crossings per region; has_road."""
    own = road_cells.groupBy("region").agg(F.count_distinct("road_id").alias("n_roads"), F.count("*").alias("n_crossings"))
    return regions.select("region").join(own, "region", "left").na.fill(0, ["n_roads", "n_crossings"]).withColumn("has_road", F.col("n_roads") > 0)


def weak_connection(edges: DataFrame, presence: DataFrame) -> DataFrame:
    """GRF-16: an edge is connected if both ends have a road."""
    a, b = (presence.select(F.col("region").alias(f"region_{s}"), F.col("has_road").alias(f"road_{s}")) for s in ("from", "to"))
    return edges.join(a, "region_from", "left").join(b, "region_to", "left").withColumn("connected", F.coalesce(F.col("road_from") & F.col("road_to"), F.lit(False)))


def strong_connection(edges: DataFrame, road_cells: DataFrame) -> DataFrame:
    """GRF-17: how many roads both ends share, and whether any."""
    a, b = (road_cells.select(F.col("region").alias(f"region_{s}"), "road_id").distinct() for s in ("from", "to"))
    ends = edges.select("region_from", "region_to")
    shared = ends.join(a, "region_from").join(b, ["region_to", "road_id"]).groupBy("region_from", "region_to").agg(F.count_distinct("road_id").alias("n_shared"))
    return ends.join(shared, ["region_from", "region_to"], "left").na.fill(0, ["n_shared"]).withColumn("connected", F.col("n_shared") > 0)


def canonical_links(nodes: DataFrame, edges: DataFrame, connections: DataFrame) -> DataFrame:
    """GRF-9: kind and region of the links a model is built on: each node, each edge for pipelines, each road-connected edge for trucks. connections: edge_region, connected."""
    own = edges.select(F.col("edge_region").alias("region")).dropDuplicates(["region"])
    trucks = own.join(connections.where("connected").select(F.col("edge_region").alias("region")), "region", "left_semi")
    kind = lambda name, df: df.select(F.lit(name).alias("kind"), "region")
    return union(kind("node", nodes.select("region").distinct()), kind("pipeline", own), kind("truck", trucks))


def process_network(efficiency: DataFrame, active: DataFrame) -> DataFrame:
    """GRF-18: live links region, period, input, tech, vintage, output.

    An edge A-B takes the input in A and makes it there into a commodity named for B: the link leads from A's input to `output@B` in A, and from `input@A` to the output in B.
    """
    keys = ["region", "tech", "vintage"]
    live = efficiency.select(*keys, "input_comm", "output_comm").join(active.select(*keys, "period").distinct(), keys)
    row = lambda df, region, a, b: df.select(region.alias("region"), "period", a.alias("input_comm"), "tech", "vintage", b.alias("output_comm"))
    node, edge = live.where(~is_edge()), live.where(is_edge())
    at = lambda comm, end: F.concat_ws("@", F.col(comm), end)
    return union(
        row(node, F.col("region"), F.col("input_comm"), F.col("output_comm")),
        row(edge, edge_from(), F.col("input_comm"), at("output_comm", edge_to())),
        row(edge, edge_to(), at("input_comm", edge_from()), F.col("output_comm")),
    )


def _reach(edges: DataFrame, start: DataFrame, keys: Sequence[str], a: str, b: str, most_steps: int) -> DataFrame:
    """keys, commodity: all that is reached from start along the edges from a to b. What is known is one table, written anew each step, so a step reads two tables however many came before."""
    step = materialize(edges.select(*keys, F.col(a).alias("commodity"), F.col(b).alias("_next")).distinct(), "steps")
    seen = materialize(start.select(*keys, "commodity").distinct().withColumn("step", F.lit(0)), "seen")
    for k in range(1, most_steps + 1):
        new = seen.where(F.col("step") == k - 1).join(step, [*keys, "commodity"]).select(*keys, F.col("_next").alias("commodity"), F.lit(k).alias("step"))
        both = seen.unionByName(new).groupBy(*keys, "commodity").agg(F.min("step").alias("step"))
        more = materialize(both, "seen")
        drop_folder(seen)
        seen = more
        if seen.where(F.col("step") == k).isEmpty():
            drop_folder(step)
            return seen.drop("step")
    raise RuntimeError("the trace did not end")


def source_trace(links: DataFrame, sources: DataFrame, demands: DataFrame, keys: Sequence[str] = ("region", "period"), most_steps: int = 200) -> DataFrame:
    """GRF-19: links on a way from a source to a demand, per key: reachable backward from demands, and from there forward from sources.

    sources and demands: keys and commodity. Frontiers advance by joins against what has been visited, so cycles end.
    """
    kept = _demand_side(links, demands, keys, most_steps)
    fore = _reach(kept, sources, keys, "input_comm", "output_comm", most_steps)
    return kept.join(fore.withColumnRenamed("commodity", "input_comm"), [*keys, "input_comm"], "left_semi")


def _demand_side(links: DataFrame, demands: DataFrame, keys: Sequence[str], most_steps: int) -> DataFrame:
    """Links from which a demand can be reached."""
    back = _reach(links, demands, keys, "output_comm", "input_comm", most_steps)
    return links.join(back.withColumnRenamed("commodity", "output_comm"), [*keys, "output_comm"], "left_semi")


def orphans(links: DataFrame, sources: DataFrame, demands: DataFrame, keys: Sequence[str] = ("region", "period"), most_steps: int = 200) -> DataFrame:
    """GRF-20: links on no way from a source to a demand, with their class: demand_side (a demand can be reached, but not from a source), other. Repeated links come once."""
    own = materialize(links.distinct(), "links")
    side = materialize(_demand_side(own, demands, keys, most_steps), "demand_side")
    fore = _reach(side, sources, keys, "input_comm", "output_comm", most_steps)
    bad = side.join(fore.withColumnRenamed("commodity", "input_comm"), [*keys, "input_comm"], "left_anti").withColumn("class", F.lit("demand_side"))
    return bad.unionByName(own.join(side, own.columns, "left_anti").withColumn("class", F.lit("other")))


def prune_orphans(links: DataFrame, sources: DataFrame, demands: DataFrame, process: Sequence[str] = ("region", "tech", "vintage"), most_rounds: int = 50) -> tuple[DataFrame, DataFrame]:
    """GRF-20: drop each process that is an orphan in any period, from all of them, until none is left. (kept, report): the links that stay, and all orphans with class and round. Keys are not null.

    An orphan lies on no way from a source to a demand, so its going changes no other link's class. Only networks (region, period) that lose a link which was none there are traced again.
    """
    keys = ["region", "period"]
    current = materialize(links.distinct(), "links")
    todo, ends, report = current, (sources, demands), []
    for k in range(most_rounds):
        bad = materialize(orphans(todo, *ends).withColumn("round", F.lit(k + 1)), "orphans")
        report.append(bad)
        gone = bad.select(*process).distinct()
        lost = current.join(gone, list(process), "left_semi").join(bad, current.columns, "left_anti").select(*keys).distinct()
        lost = materialize(lost, "networks")
        more = materialize(current.join(gone, list(process), "left_anti"), "links")
        drop_folder(current)
        current = more
        if lost.isEmpty():
            drop_folder(lost)
            return current, union(*report)
        todo, ends = current.join(lost, keys, "left_semi"), tuple(df.join(lost, keys, "left_semi") for df in (sources, demands))
    raise RuntimeError("pruning did not end")


def linked_prescreen(linked: DataFrame, present: DataFrame) -> DataFrame:
    """GRF-21: for each linked pair (region, driver, driven): both present, driver removed, driven removed, or both removed."""
    own = present.select("region", "tech").distinct()
    a, b = own.select("region", F.col("tech").alias("driver"), F.lit(True).alias("_a")), own.select("region", F.col("tech").alias("driven"), F.lit(True).alias("_b"))
    out = linked.join(a, ["region", "driver"], "left").join(b, ["region", "driven"], "left")
    status = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_b"), "driver removed").when(F.col("_a"), "driven removed").otherwise("both removed")
    return out.withColumn("status", status).drop("_a", "_b")


def unsupported(demands: DataFrame, links: DataFrame) -> DataFrame:
    """GRF-22: demands that no link makes."""
    return demands.join(links.select("region", "period", F.col("output_comm").alias("commodity")).distinct(), ["region", "period", "commodity"], "left_anti")


def viable(df: DataFrame, known: DataFrame, keys: Sequence[str], region: str = "region") -> DataFrame:
    """GRF-23: rows with a viable key; a group region (with + or global) passes if the rest of its key is viable anywhere."""
    group = F.col(region).contains("+") | (F.col(region) == "global")
    rest = [k for k in keys if k != region]
    return df.where(~group).join(known.select(*keys).distinct(), list(keys), "left_semi").unionByName(df.where(group).join(known.select(*rest).distinct(), rest, "left_semi"))


def corridor_ranks(links: DataFrame, order: DataFrame, spread: float, most: float) -> DataFrame:
    """GRF-24: links(region, mode, name) per undirected route: rank by mode order and name, centred offset clipped to +-most and turned for reversed rows, and the route's count and modes."""
    keyed = links.join(order, "mode").withColumns({"route": undirected_key(), "reversed": edge_from() > edge_to()})
    own = W.partitionBy("route")
    rank = F.row_number().over(own.orderBy("rank", "name", "region"))
    n = F.count("*").over(own)
    raw = F.greatest(F.lit(-most), F.least(F.lit(most), (F.col("place") - (F.col("n") + 1) / 2) * spread))
    out = keyed.withColumns({"place": rank, "n": n, "modes": F.array_join(F.array_sort(F.collect_set("mode").over(own)), ",")})
    return out.withColumn("offset", F.when(F.col("reversed"), -raw).otherwise(raw))


def balance_set(links: DataFrame) -> DataFrame:
    """GRF-25: (region, period, commodity) that something makes and something uses, edges counted at their ends."""
    ends = lambda r, c: links.select(r.alias("region"), "period", F.col(c).alias("commodity"))
    made = ends(F.coalesce(edge_to(), F.col("region")), "output_comm")
    used = ends(F.coalesce(edge_from(), F.col("region")), "input_comm")
    return made.intersect(used)


def exchange_maps(links: DataFrame) -> DataFrame:
    """GRF-26: per exporter and commodity its importers (region and tech), as a sorted array; exchanged links swap the roles."""
    edges = links.where(is_edge()).select(edge_from().alias("exporter"), edge_to().alias("importer"), "output_comm", "tech").distinct()
    return edges.groupBy("exporter", "output_comm").agg(F.array_sort(F.collect_set(F.struct("importer", "tech"))).alias("importers"))


def edge_lines(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """GEO-13: the straight segment x0, y0, x1, y1 between the centres of each edge's ends."""
    a, b = (cells.select(F.col("region").alias(r), F.col("cx").alias(x), F.col("cy").alias(y)) for r, x, y in (("region_from", "x0", "y0"), ("region_to", "x1", "y1")))
    return edges.join(a, "region_from").join(b, "region_to")
