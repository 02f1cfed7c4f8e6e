"""Cost fits and curves (CST-*) and model-table encoding (ENC-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.joins import ContractError, checked_join, full_diff


def not_positive(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """CST-1: values that are no positive number."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")
    return df.select(*keys, cells).select(*keys, "x.*").where(~F.coalesce(F.col("value").try_cast("double") > 0, F.lit(False)))


def key_differences(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """CST-2: cases that one of two cost tables lacks, repeats counted."""
    return full_diff(left.select(*keys), right.select(*keys))


def fits(points: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """CST-4: linear y = a + b x and power y = k x^e by least squares (the power in logarithms), for groups of two different x at least."""
    lx, ly = F.ln(x), F.ln(y)
    out = points.groupBy(*keys).agg(
        F.regr_intercept(y, x).alias("a"), F.regr_slope(y, x).alias("b"), F.exp(F.regr_intercept(ly, lx)).alias("k"), F.regr_slope(ly, lx).alias("e"), F.count_distinct(x).alias("n_x")
    )
    return out.where("n_x >= 2").drop("n_x")


def fit_metrics(points: DataFrame, fitted: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """CST-5: for each group and model, R2 in cost units (null without spread), RMSE, MAE and largest error of predictions."""
    both = points.join(fitted, list(keys)).withColumn("_mean", F.avg(y).over(W.partitionBy(*keys)))
    models = F.explode(F.array(F.struct(F.lit("linear").alias("model"), (F.col("a") + F.col("b") * F.col(x)).alias("p")), F.struct(F.lit("power").alias("model"), (F.col("k") * F.pow(x, "e")).alias("p"))))
    err = F.col(y) - F.col("m.p")
    out = both.withColumn("m", models).groupBy(*keys, "m.model").agg(
        F.sum(err * err).alias("_rss"), F.sum(F.pow(F.col(y) - F.col("_mean"), 2)).alias("_tss"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"), F.max(F.abs(err)).alias("max_error")
    )
    return out.withColumn("r2", F.when(F.col("_tss") > 0, 1 - F.col("_rss") / F.col("_tss"))).drop("_rss", "_tss")


def select_models(metrics: DataFrame, wanted: DataFrame, keys: Sequence[str], cost_type: str = "cost_type") -> DataFrame:
    """CST-6: the rows of the one model that wanted(cost_type, model) names for each cost type; not just one is an error."""
    if wanted.groupBy(cost_type).count().where("count <> 1").limit(1).count():
        raise ContractError("a cost type needs just one model")
    return metrics.join(wanted, [cost_type, "model"])


def piecewise_template(curves: DataFrame, keys: Sequence[str], n: int, spacing: str = "log") -> DataFrame:
    """CST-7: n segments of cost k x^e from capacity 0 up to hi, breaks spaced evenly in the logarithm from lo, or evenly."""
    i = F.explode(F.sequence(F.lit(1), F.lit(n))).alias("segment")
    part = (F.col("segment") - 1) / F.lit(max(n - 1, 1))
    upper = F.exp(F.ln("lo") + part * (F.ln("hi") - F.ln("lo"))) if spacing == "log" else F.col("lo") + part * (F.col("hi") - F.col("lo"))
    rows = curves.select(*keys, "k", "e", "lo", "hi", i).withColumn("cap_upper", upper).withColumn("cost_upper", F.col("k") * F.pow("cap_upper", "e"))
    w = W.partitionBy(*keys).orderBy("segment")
    return rows.select(*keys, "segment", F.coalesce(F.lag("cap_upper").over(w), F.lit(0.0)).alias("cap_lower"), "cap_upper", F.coalesce(F.lag("cost_upper").over(w), F.lit(0.0)).alias("cost_lower"), "cost_upper")


def learning_curve(curves: DataFrame, keys: Sequence[str], n: int, spacing: str = "log") -> DataFrame:
    """CST-9: cumulative cost a/(b+1) q^(b+1) at n breaks: upper (10^u - 1)/9 with u from 0 to 1, or evenly."""
    u = F.col("segment") / n
    q = F.col("upper") * ((F.pow(F.lit(10.0), u) - 1) / 9 if spacing == "log" else u)
    rows = curves.select(*keys, "a", "b", "upper", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("segment")).withColumn("quantity", q)
    return rows.select(*keys, "segment", "quantity", (F.col("a") / (F.col("b") + 1) * F.pow("quantity", F.col("b") + 1)).alias("cost"))


def expand_curve(curve: DataFrame, edges: DataFrame, distance: str, by: str = "relative") -> DataFrame:
    """CST-10: every segment on every edge, cost times the edge's distance over the mean of all edges, or times kilometres. curve: a few segments."""
    mean = edges.agg(F.avg(distance).alias("_mean"))
    scale = F.col(distance) / F.col("_mean") if by == "relative" else F.col(distance)
    rows = edges.crossJoin(mean).crossJoin(curve)
    return rows.withColumns({"cost_lower": F.col("cost_lower") * scale, "cost_upper": F.col("cost_upper") * scale}).drop("_mean")


def opex_rows(edges: DataFrame, slopes: DataFrame) -> DataFrame:
    """CST-11: fixed and variable cost per edge and technology: slope times the distance of its kind. slopes: tech, fixed, variable."""
    return edges.select("edge_region", "fixed_km", "variable_km").crossJoin(slopes).select("edge_region", "tech", (F.col("fixed") * F.col("fixed_km")).alias("fixed"), (F.col("variable") * F.col("variable_km")).alias("variable"))


def transport_rows(edges: DataFrame, modes: DataFrame, distance: str) -> DataFrame:
    """CST-12: per edge and technology a variable cost of intercept + cost per km times km, and efficiency 1. modes: tech, intercept, per_km."""
    return edges.crossJoin(modes).select("edge_region", "tech", (F.col("intercept") + F.col("per_km") * F.col(distance)).alias("cost"), F.lit(1.0).alias("efficiency"))


def evaluate_curve(capacity: DataFrame, curve: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """CST-13: cost of a capacity on its piecewise curve (straight in a segment; 0 at 0; null beyond the end), less the cost at the period before."""
    on = [capacity[k] == curve[f"c_{k}"] for k in keys]
    hit = capacity.join(curve, [*on, capacity["capacity"] > curve["cap_lower"], capacity["capacity"] <= curve["cap_upper"]], "left")
    line = F.col("cost_lower") + (F.col("cost_upper") - F.col("cost_lower")) * (F.col("capacity") - F.col("cap_lower")) / (F.col("cap_upper") - F.col("cap_lower"))
    out = hit.select(*(capacity[k] for k in keys), order, "capacity", F.when(F.col("capacity") == 0, 0.0).otherwise(line).alias("total"))
    return out.withColumn("step", F.col("total") - F.coalesce(F.lag("total").over(W.partitionBy(*keys).orderBy(order)), F.lit(0.0)))


def curve_problems(curve: DataFrame, keys: Sequence[str], strict: bool = True, tolerance: float = 1e-9) -> DataFrame:
    """CST-14: segments that are negative, don't rise, or don't start where the one before ends; equal bounds pass unless strict."""
    w = W.partitionBy(*keys).orderBy("segment")
    rows = curve.withColumns({"_cap": F.coalesce(F.lag("cap_upper").over(w), F.lit(0.0)), "_cost": F.coalesce(F.lag("cost_upper").over(w), F.lit(0.0))})
    falls = (F.col("cap_upper") <= F.col("cap_lower")) if strict else (F.col("cap_upper") < F.col("cap_lower"))
    found = F.array_compact(
        F.array(
            F.when(F.least("cap_lower", "cap_upper", "cost_lower", "cost_upper") < 0, "negative"),
            F.when(falls | (F.col("cost_upper") < F.col("cost_lower")), "does not rise"),
            F.when((F.abs(F.col("cap_lower") - F.col("_cap")) > tolerance) | (F.abs(F.col("cost_lower") - F.col("_cost")) > tolerance), "gap"),
        )
    )
    return rows.select(*keys, "segment", F.explode(found).alias("finding"))


def site_attributes(regions: DataFrame, sites: DataFrame, facilities: DataFrame, demand: DataFrame) -> DataFrame:
    """ENC-1: per region mean cost and summed potential of sites, positive emissions in tonnes (given in kilotonnes) with their count, and demand; 0 for none."""
    a = sites.groupBy("region").agg(F.avg("cost").alias("mean_cost"), F.sum("potential").alias("potential"))
    b = facilities.where("emissions > 0").groupBy("region").agg((F.sum("emissions") * 1000).alias("emissions"), F.count("*").alias("n_facilities"))
    c = demand.groupBy("region").agg(F.sum("demand").alias("demand"))
    return regions.select("region").join(a, "region", "left").join(b, "region", "left").join(c, "region", "left").na.fill(0, ["mean_cost", "potential", "emissions", "n_facilities", "demand"])


def demand_rows(regional: DataFrame, periods: DataFrame, commodity: str) -> DataFrame:
    """ENC-2: positive demand of each region in each period, as tonnes a year."""
    return regional.where("demand > 0").crossJoin(F.broadcast(periods.select("period"))).select("region", "period", F.lit(commodity).alias("commodity"), "demand")


def capacity_limits(sites: DataFrame, period: int, capture: str, power: str) -> DataFrame:
    """ENC-3: two `le` limits a region: capture by its emissions, power by its potential."""
    stacked = sites.selectExpr("region", f"stack(2, '{capture}', emissions, '{power}', potential) AS (tech_or_group, capacity)")
    return stacked.select("region", F.lit(period).alias("period"), "tech_or_group", F.lit("le").alias("operator"), "capacity")


def annual_target(limits: DataFrame, tech: str, period: int, years: int, target: float | None) -> DataFrame:
    """ENC-4: a cumulative target as one yearly `ge` row for `global`, in place of older rows of the technology; without one those only go."""
    rest = limits.where(F.col("tech_or_group") != tech)
    if target is None:
        return rest
    row = limits.sparkSession.range(1).select(F.lit("global").alias("region"), F.lit(period).alias("period"), F.lit(tech).alias("tech_or_group"), F.lit("ge").alias("operator"), F.lit(target / years).alias("activity"))
    return rest.unionByName(row)


def supply_caps(regional: DataFrame, years: int, period_years: int, tech: str) -> DataFrame:
    """ENC-5: years of demand over the period, per region with demand."""
    return regional.where("demand > 0").select("region", F.lit(tech).alias("tech_or_group"), F.lit("le").alias("operator"), (F.col("demand") * years / period_years).alias("activity"))


def replace_costs(inherited: DataFrame, own: DataFrame) -> DataFrame:
    """ENC-6: own rows, and the inherited ones of other technologies."""
    return inherited.join(own.select("tech").distinct(), "tech", "left_anti").unionByName(own)


def input_splits(regions: DataFrame, splits: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """ENC-7: the proportions (tech, input_comm, proportion) on every region; a technology's must sum to 1."""
    if bad := splits.groupBy("tech").agg(F.sum("proportion").alias("s")).where(F.abs(F.col("s") - 1) > tolerance).first():
        raise ContractError(f"the inputs of {bad.tech} sum to {bad.s}")
    return regions.select("region").crossJoin(splits).select("region", "input_comm", "tech", F.lit("e").alias("operator"), "proportion")


def node_efficiency(regions: DataFrame, technologies: DataFrame, demand_nodes: DataFrame) -> DataFrame:
    """ENC-8: each (tech, input_comm, output_comm) on all nodes, or on demand nodes only where it says so."""
    every = regions.select("region").join(technologies.where("NOT demand_only"), F.lit(True))
    some = demand_nodes.select("region").distinct().join(technologies.where("demand_only"), F.lit(True))
    return every.unionByName(some).select("region", "input_comm", "tech", "output_comm", F.lit(1.0).alias("efficiency"))


def uncovered(tables: dict[str, DataFrame], nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """ENC-10: regions of each table that are neither a known node nor a known edge."""
    known = nodes.select("region").union(edges.select(F.col("edge_region").alias("region"))).distinct()
    parts = [df.select(F.lit(n).alias("table"), "region").distinct() for n, df in tables.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.join(known, "region", "left_anti")


def finance_elements(base: DataFrame, values: dict[str, float]) -> DataFrame:
    """ENC-9: base(element, value) with these values put in or over the old ones."""
    own = F.explode(F.array(*(F.struct(F.lit(k).alias("element"), F.lit(float(v)).alias("value")) for k, v in values.items()))).alias("x")
    new = base.sparkSession.range(1).select(own).select("x.*")
    return base.join(F.broadcast(new), "element", "left_anti").unionByName(new)



def merge_costs(capex: DataFrame, variable: DataFrame, fixed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """CST-3: one row a case with its three costs; a case given twice in any table is an error."""
    return checked_join(checked_join(capex, variable, keys, cardinality="1:1"), fixed, keys, cardinality="1:1")


def opex_template(fitted: DataFrame, keys: Sequence[str], unit: str) -> DataFrame:
    """CST-8: the slope of each linear fit with its unit a kilometre; intercepts are left out."""
    return fitted.select(*keys, F.col("b").alias("slope"), F.lit(f"{unit}/km").alias("unit"))


def technology_table(raw: DataFrame, required: DataFrame, values: dict[str, str | int]) -> DataFrame:
    """ENC-9: the technology table of a model: raw rows with the columns of values set to them, added where absent. A required technology (tech) that raw lacks is an error."""
    missing = [r.tech for r in required.select("tech").distinct().join(raw, "tech", "left_anti").orderBy("tech").limit(10).collect()]
    if missing:
        raise ContractError(f"technologies without a definition, the first ten: {missing}")
    return raw.withColumns({c: F.lit(v) for c, v in values.items()})


def period_table(bounds: DataFrame) -> DataFrame:
    """ENC-9: sequence, period and flag (f, future) of the periods of bounds (period), in order."""
    return bounds.select("period").distinct().select(F.row_number().over(W.orderBy("period")).alias("sequence"), "period", F.lit("f").alias("flag"))  # a row a period


def label_table(df: DataFrame, label: str, descriptions: dict[str, str]) -> DataFrame:
    """ENC-9: label and description of each label that df uses; one without a description has null."""
    words = F.create_map(*(F.lit(x) for pair in descriptions.items() for x in pair)) if descriptions else F.lit(None).cast("map<string,string>")
    return df.select(F.col(label).alias("label")).distinct().withColumn("description", F.element_at(words, F.col("label")))


def encode_static(technologies: DataFrame, commodities: DataFrame, required: DataFrame, bounds: DataFrame, metadata: DataFrame, finance: dict[str, float], values: dict[str, str | int], types: dict[str, str]) -> dict[str, DataFrame]:
    """ENC-9: the supporting tables of a model by name: Technology, Commodity, TechnologyType and SectorLabel (labels that the technologies use), TimePeriod and MetaDataReal with the finance elements put in.

    technologies: tech, flag (the type) and more; values: the columns of technology_table(), with sector; metadata: element, value.
    """
    technology = technology_table(technologies, required, values)
    return {
        "Technology": technology, "Commodity": commodities, "TechnologyType": label_table(technology, "flag", types), "SectorLabel": technology.select("sector", F.concat(F.col("sector").cast("string"), F.lit(" sector")).alias("notes")).distinct(),
        "TimePeriod": period_table(bounds), "MetaDataReal": finance_elements(metadata, finance),
    }
