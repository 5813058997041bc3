"""The graphs that stand in for edge tables: built from the test tables, as DataFrames and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

G1_SQL = "(SELECT l_suppkey AS pre, l_partkey + 1000000 AS post, count(*) AS w FROM lineitem GROUP BY ALL)"
G2_SQL = "(SELECT pre, post, count(*) AS w FROM (SELECT user_id AS pre, lead(user_id) OVER (ORDER BY ts, event_id) AS post FROM events) WHERE post IS NOT NULL GROUP BY ALL)"
G3_SQL = """(SELECT s_nationkey AS pre, c_nationkey AS post, count(*) AS w FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
    JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"""


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bipartite_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line item: (pre, post, w = 1)."""
    return _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pre"), (F.col("l_partkey") + 1_000_000).alias("post"), F.lit(1).alias("w"))


def bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bipartite_raw(spark, sf_dir).groupBy("pre", "post").agg(F.count(F.lit(1)).alias("w"))


def directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's user to the next event's. The order is over the whole log, so the log is cut by day and each day's last event
    meets the first of the next day that has one."""
    events = _t(spark, sf_dir, "events").select("ts", "event_id", "user_id", F.to_date("ts").alias("day"))
    inside = Window.partitionBy("day").orderBy("ts", "event_id")
    ends = events.groupBy("day").agg(F.min(F.struct("ts", "event_id", "user_id")).alias("a"), F.max(F.struct("ts", "event_id", "user_id")).alias("z"))
    days = Window.orderBy("day")  # one row a day
    across = ends.select(F.col("z.user_id").alias("pre"), F.lead("a.user_id").over(days).alias("post"))
    pairs = events.select(F.col("user_id").alias("pre"), F.lead("user_id").over(inside).alias("post")).unionByName(across)
    return pairs.where("post is not null").groupBy("pre", "post").agg(F.count(F.lit(1)).alias("w"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders")
    supplier, customer = _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "customer")
    joined = line.join(supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(customer, F.col("c_custkey") == F.col("o_custkey"))
    return joined.groupBy(F.col("s_nationkey").alias("pre"), F.col("c_nationkey").alias("post")).agg(F.count(F.lit(1)).alias("w"))
