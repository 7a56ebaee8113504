"""Edge tables derived from the star-schema tables; the same SQL runs in other engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Name: the tables it reads, and its SQL with the tables in braces.
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "f1": (("customer", "lineitem", "orders"), "WITH b AS (SELECT DISTINCT o_custkey s, (SELECT max(c_custkey) + 1 FROM {customer}) + l_partkey t FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_quantity >= 49) SELECT s src, t dst FROM b UNION ALL SELECT t, s FROM b"),
    "f2": (("part", "lineitem"), "WITH b AS (SELECT DISTINCT l_partkey s, (SELECT max(p_partkey) + 1 FROM {part}) + l_suppkey t FROM {lineitem}) SELECT s src, t dst FROM b UNION ALL SELECT t, s FROM b"),
    "f3": (("orders",), "SELECT src, dst FROM (SELECT o_orderkey src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) dst FROM {orders}) WHERE dst IS NOT NULL"),
    "f4": (("events",), "SELECT src, dst FROM (SELECT user_id src, lead(user_id) OVER (ORDER BY ts, event_id) dst FROM {events}) WHERE dst IS NOT NULL"),
    "f5": (("conversations",), "SELECT a.conv_id * 8 + a.turn src, b.conv_id * 8 + b.turn dst FROM {conversations} a JOIN {conversations} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"),
}


def _following(events: DataFrame) -> DataFrame:
    """f4 without a window over all events: followers within an hour, and the first event of the next hour with any."""
    at = F.struct("ts", "event_id")
    rows = events.select("user_id", at.alias("at"), F.date_trunc("hour", "ts").alias("hour"))
    own = rows.withColumn("dst", F.lead("user_id").over(Window.partitionBy("hour").orderBy("at")))
    first = rows.groupBy("hour").agg(F.min_by("user_id", "at").alias("head"))
    after = first.select("hour", F.lead("head").over(Window.orderBy("hour")).alias("next"))  # a row per hour
    return own.join(after, "hour").select(F.col("user_id").alias("src"), F.coalesce("dst", "next").alias("dst")).dropna(subset=["dst"])


def edges(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "f4":
        return _following(spark.read.parquet(f"{sf_dir}/events.parquet")).selectExpr("cast(src as bigint) src", "cast(dst as bigint) dst")
    tables, sql = SQL[name]
    views = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    return spark.sql(sql, **views).selectExpr("cast(src as bigint) src", "cast(dst as bigint) dst")


def plain_sql(name: str) -> str:
    """The same text with bare table names."""
    tables, sql = SQL[name]
    return sql.format(**{t: t for t in tables})
