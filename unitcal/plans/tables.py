"""The star-schema tables in the roles of a message series.

The customer's orders are the messages of a unit; the time left is counted in days to
the last order date of the data; the order price is the value to forecast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitcal.functions import draw_bits
from unitcal.operators.series import forecast_frame
from unitcal.roles import SeriesSpec

ORDERS = SeriesSpec(unit="unit", ttr="ttr", tie="tie", value="value", group="grp")
CUTOFF, RECENCY = 180.0, 90.0
THRESHOLD, EPSILON, CONSTANT, MARGIN = 450000.0, 0.001, 460000.0, 0.001
LEVELS = (0.9, 0.8, 0.95)
SEED = 42
REFERENCE_DAY = "2001-08-01"
TAUS = tuple(300000.0 + 12500.0 * i for i in range(13))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def split_of(unit: str) -> Column:
    """Half of the units train, half test, by a hash of the unit id."""
    return F.when(draw_bits("split", F.col(unit)) < 2147483648, "train").otherwise("test")


def messages(spark: SparkSession, sf: str, group: bool = False) -> DataFrame:
    """Orders as messages.  The customer table is joined only when the group is asked for."""
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("unit"),
        F.col("o_orderkey").alias("tie"),
        F.date_diff(F.lit(REFERENCE_DAY).cast("date"), F.col("o_orderdate").cast("date"))
        .cast("double").alias("ttr"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderpriority").alias("priority"),
    )
    orders = orders.withColumn("split", split_of("unit"))
    if not group:
        return orders
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("unit"), F.col("c_mktsegment").alias("grp")
    )
    return orders.join(customers, "unit")


def pairs(spark: SparkSession, sf: str, group: bool = False) -> DataFrame:
    """One row per forecastable customer: split, (group,) target, its time and the as-of value."""
    # the split follows from the unit, so it is hashed once per customer, after the aggregation
    frame = (
        forecast_frame(messages(spark, sf), ORDERS, CUTOFF)
        .filter(F.col("known").isNotNull())
        .withColumn("split", split_of("unit"))
    )
    if not group:
        return frame
    # the group is joined after the orders were reduced to one row per customer
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("unit"), F.col("c_mktsegment").alias("grp")
    )
    return frame.join(customers, "unit")


# --- the same roles in SQL ---------------------------------------------------------------

M = """m AS (
  SELECT o_custkey AS unit, o_orderkey AS tie,
         CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS DOUBLE) AS ttr,
         o_totalprice AS value, o_orderpriority AS priority, c_mktsegment AS grp,
         CASE WHEN CAST('0x' || substr(md5('split:' || o_custkey), 1, 8) AS BIGINT) < 2147483648
              THEN 'train' ELSE 'test' END AS split
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
U = """u AS (
  SELECT unit, min(split) AS split, min(grp) AS grp, count(*) AS n_msgs,
         min(ttr) AS last_ttr, max(ttr) AS first_ttr,
         count(*) FILTER (WHERE ttr >= 180) AS n_admissible
  FROM m GROUP BY unit)"""
T = """t AS (
  SELECT unit, value AS target, ttr AS target_ttr
  FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY ttr, tie DESC) AS rn FROM m)
  WHERE rn = 1)"""
A = """a AS (
  SELECT unit, value AS known
  FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY ttr, tie) AS rn FROM m WHERE ttr >= 180)
  WHERE rn = 1)"""
P = """p AS (
  SELECT u.*, t.target, t.target_ttr, a.known FROM u JOIN t USING (unit) JOIN a USING (unit))"""
PAIRS = f"WITH RECURSIVE {M}, {U}, {T}, {A}, {P}"


def sql_quantile(value: str, p: float) -> str:
    return f"quantile_cont({value}, {p})"


def sql_draw(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"
