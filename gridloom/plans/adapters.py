"""The given tables as domain tables.

Each adapter is one SQL text that Spark and DuckDB read alike; {name} stands for another adapter or a given table. Spark reads the Parquet files in place.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from gridloom.session import materialize

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_FIVE = "CAST(floor(year({0}) / 5) * 5 AS INT)"

ADAPTERS = {
    # a row a line item: where it comes from and goes to, when, by which technology
    "moves": f"""
        SELECT l_returnflag AS scenario, s_nationkey % 5 AS i, c_nationkey % 5 AS j, {_FIVE.format('l_shipdate')} AS period,
          concat('S', CAST(quarter(l_shipdate) AS STRING)) AS season, concat('T', CAST(l_linenumber % 4 AS STRING)) AS tod,
          p_type AS input_comm, p_brand AS tech, {_FIVE.format('o_orderdate')} AS vintage, o_orderpriority AS output_comm,
          l_quantity AS quantity, l_discount AS discount, l_tax AS tax, l_extendedprice AS price
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey
          JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{part}} ON l_partkey = p_partkey""",
    "placed": """
        SELECT *, CASE WHEN i = j THEN concat('R', CAST(i AS STRING)) ELSE concat('R', CAST(i AS STRING), '-R', CAST(j AS STRING)) END AS region FROM {moves}""",
    "flow_out": """
        SELECT scenario, region, period, season, tod, input_comm, tech, vintage, output_comm, sum(quantity) AS flow FROM {placed}
        GROUP BY scenario, region, period, season, tod, input_comm, tech, vintage, output_comm""",
    "flow_in": """
        SELECT scenario, region, period, season, tod, input_comm, tech, vintage, output_comm, sum(quantity / (1 - discount)) AS flow FROM {placed}
        GROUP BY scenario, region, period, season, tod, input_comm, tech, vintage, output_comm""",
    "flows": """
        SELECT scenario, region, period, season, tod, input_comm, tech, vintage, output_comm, sum(quantity) AS made, sum(quantity / (1 - discount)) AS drawn FROM {placed}
        GROUP BY scenario, region, period, season, tod, input_comm, tech, vintage, output_comm""",
    "scenarios": "SELECT DISTINCT l_returnflag AS scenario FROM {lineitem}",
    "demand": f"""
        SELECT concat('R', CAST(c_nationkey % 5 AS STRING)) AS region, {_FIVE.format('o_orderdate')} AS period, o_orderpriority AS commodity, sum(o_totalprice) / 1e4 AS demand
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey GROUP BY 1, 2, 3""",
    "commodity": """
        SELECT name, CASE WHEN length(name) % 7 = 0 THEN 's' WHEN length(name) % 5 = 0 THEN 'a' ELSE 'p' END AS flag FROM (SELECT DISTINCT p_type AS name FROM {part})
        UNION ALL SELECT DISTINCT o_orderpriority, 'd' FROM {orders}""",
    "technology": """
        SELECT tech, CASE WHEN n % 3 = 0 THEN 'power' WHEN n % 3 = 1 THEN 'transport' ELSE 'industry' END AS sector,
          CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END AS unlim_cap, CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END AS annual, CASE WHEN n % 5 = 1 THEN 1 ELSE 0 END AS flex,
          CASE WHEN n % 6 = 0 THEN 1 ELSE 0 END AS curtail, CASE WHEN n % 10 = 0 THEN 1 ELSE 0 END AS baseload, CASE WHEN n % 7 = 0 THEN 1 ELSE 0 END AS reserve
        FROM (SELECT p_brand AS tech, min(p_partkey) AS n FROM {part} GROUP BY p_brand)""",
    "period": "SELECT DISTINCT period FROM {moves}",
    "net_capacity": """
        SELECT scenario, region, period, tech, vintage, max(quantity) * 4 AS capacity FROM {placed} GROUP BY scenario, region, period, tech, vintage""",
    "built_capacity": """
        SELECT scenario, region, tech, vintage, max(quantity) * 5 AS capacity FROM {placed} GROUP BY scenario, region, tech, vintage""",
    "cost_invest": "SELECT region, tech, vintage, max(price) / 1000 AS cost FROM {placed} WHERE tax > 0.02 GROUP BY region, tech, vintage",
    "cost_fixed": "SELECT region, period, tech, vintage, avg(tax) AS cost FROM {placed} WHERE tax > 0.03 GROUP BY region, period, tech, vintage",
    "cost_variable": "SELECT region, period, tech, vintage, avg(discount) AS cost FROM {placed} WHERE discount > 0.04 GROUP BY region, period, tech, vintage",
    "efficiency": "SELECT region, input_comm, tech, vintage, output_comm, 1 - avg(discount) AS efficiency FROM {placed} GROUP BY region, input_comm, tech, vintage, output_comm",
    "lifetime_process": "SELECT region, tech, vintage, CAST(10 + max(quantity) % 7 AS INT) AS lifetime FROM {placed} WHERE quantity > 45 GROUP BY region, tech, vintage",
    "lifetime_tech": "SELECT region, tech, CAST(12 + max(quantity) % 5 AS INT) AS lifetime FROM {placed} WHERE quantity > 30 GROUP BY region, tech",
    "slices": """
        SELECT 1995 + 5 * CAST(user_id % 2 AS INT) AS period, concat('S', CAST(event_id % 4 + 1 AS STRING)) AS season, concat('T', CAST(floor(hour(ts) / 6) AS INT)) AS tod, count(*) AS n
        FROM {events} GROUP BY 1, 2, 3""",
    "segfrac": """
        SELECT period, season, tod, n / (sum(n) OVER (PARTITION BY period)) AS segfrac FROM {slices}""",
    "emission_activity": "SELECT region, 'co2' AS emis_comm, input_comm, tech, vintage, output_comm, avg(tax) * 10 AS activity FROM {placed} GROUP BY region, input_comm, tech, vintage, output_comm",
    "points": """
        SELECT concat('s', CAST(s_suppkey AS STRING)) AS point_id, -141 + ((s_suppkey * 37) % 8800) / 1e2 AS lon, 42 + ((s_suppkey * 53) % 4000) / 1e2 AS lat, s_acctbal AS value, s_nationkey AS jurisdiction FROM {supplier}
        UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), -141 + ((c_custkey * 37) % 8800) / 1e2, 42 + ((c_custkey * 53) % 4000) / 1e2, c_acctbal, c_nationkey FROM {customer}""",
    "facilities": """
        SELECT CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS STRING) END AS facility_id, CASE WHEN c_custkey % 53 = 0 THEN NULL ELSE c_name END AS name,
          CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_custkey % 31 = 0 THEN 0.0 ELSE -141 + ((c_custkey * 37) % 8800) / 1e2 END AS lon,
          CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE 38 + ((c_custkey * 53) % 4000) / 1e2 END AS lat,
          CASE WHEN c_custkey % 61 = 0 THEN 0.0 ELSE c_acctbal END AS emissions, c_nationkey AS jurisdiction FROM {customer}""",
}


#: The rows of {placed} for a table that is written without fractions, whose sums depend on the order of rows: customers meet the orders, suppliers and parts the line items, and what is derived from either side goes through the one shuffle by order.
_JOINED = f"""
    SELECT scenario, i, j, period, concat('S', CAST(quarter AS STRING)) AS season, concat('T', CAST(turn AS STRING)) AS tod, input_comm, tech, vintage, output_comm, quantity, discount, tax, price,
      CASE WHEN i = j THEN concat('R', CAST(i AS STRING)) ELSE concat('R', CAST(i AS STRING), '-R', CAST(j AS STRING)) END AS region
    FROM (SELECT l_orderkey, l_returnflag AS scenario, s_nationkey % 5 AS i, {_FIVE.format('l_shipdate')} AS period, quarter(l_shipdate) AS quarter, l_linenumber % 4 AS turn, p_type AS input_comm, p_brand AS tech,
      l_quantity AS quantity, l_discount AS discount, l_tax AS tax, l_extendedprice AS price FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{part}} ON l_partkey = p_partkey) l
    JOIN (SELECT o_orderkey, c_nationkey % 5 AS j, {_FIVE.format('o_orderdate')} AS vintage, o_orderpriority AS output_comm FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey) o ON l_orderkey = o_orderkey"""

PLACED = ("scenario", "i", "j", "period", "season", "tod", "input_comm", "tech", "vintage", "output_comm", "quantity", "discount", "tax", "price", "region")


def text(sql: str, sf_dir: str | None = None, kept: dict[str, str] | None = None) -> str:
    """sql with every {name} put in; given tables by path for Spark, by name without one. kept: adapters that are written, with their paths."""

    def put(m: re.Match) -> str:
        name = m[1]
        if kept and name in kept:
            return f"parquet.`{kept[name]}` AS {name}"
        if name in ADAPTERS:
            return f"({text(ADAPTERS[name], sf_dir, kept)}) AS {name}"
        if name not in GIVEN:
            raise KeyError(name)
        return name if sf_dir is None else f"parquet.`{sf_dir}/{name}.parquet` AS {name}"

    return re.sub(r"\{(\w+)\}", put, sql)


def uses(sql: str, name: str = "moves") -> int:
    """How often an SQL text reads an adapter, through others too."""
    return sum(1 if n == name else uses(ADAPTERS[n], name) if n in ADAPTERS else 0 for n in re.findall(r"\{(\w+)\}", sql))


def columns(sql: str) -> set[str]:
    """The columns of {placed} that an SQL text may read, itself or through other adapters: those it names, or all where it takes every one."""
    if re.search(r"\*\s+FROM\s+\{(moves|placed)\}", sql):
        return set(PLACED)
    found = set(re.findall(r"\w+", sql)) & set(PLACED)
    return found.union(*(columns(ADAPTERS[n]) for n in re.findall(r"\{(\w+)\}", sql) if n in ADAPTERS and n not in ("moves", "placed") and uses(ADAPTERS[n])))


class Tables:
    """Domain tables by name, lazily.

    once: columns of the joined line items ({moves}, {placed}) that are written to the shared folder when first needed, for queries that read them several times; all are, if these don't do.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, once: set[str] | None = None) -> None:
        self.spark, self.sf_dir, self.once, self.kept, self.held = spark, sf_dir, once, {}, set()

    def __call__(self, name: str) -> DataFrame:
        if name in GIVEN:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.sql(f"SELECT * FROM {{{name}}}")

    def sql(self, sql: str) -> DataFrame:
        """A frame from an SQL text over adapters and given tables."""
        if self.once is not None and uses(sql) and not (self.kept and columns(sql) <= self.held):
            self.held = set(PLACED) if self.kept or not columns(sql) <= self.once else self.once
            placed = materialize(self.spark.sql(text("SELECT * FROM {placed}" if self.held & {"discount", "tax", "price"} else _JOINED, self.sf_dir)).select(*(c for c in PLACED if c in self.held)), "placed")
            path = placed.inputFiles()[0].rsplit("/", 1)[0]
            self.kept = {"moves": path, "placed": path}
        return self.spark.sql(text(sql, self.sf_dir, self.kept))
