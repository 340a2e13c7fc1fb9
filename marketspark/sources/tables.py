"""The captured Parquet tables, and the market views over them.

| view | stands on |
|---|---|
| competitors | supplier, nation, region |
| pricing | lineitem, part: a price observation per line |
| services | which supplier offers which part |
| collection_logs | orders: a run per order |
| change_events | events |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    geo = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    return s.join(geo, s.s_nationkey == geo.n_nationkey).select(
        F.col("s_suppkey").alias("competitor_id"), F.col("s_name").alias("name"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), (F.col("s_acctbal") >= 0).alias("enabled"), F.col("s_acctbal").alias("balance")
    )


def pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    base = F.col("l_extendedprice") / F.col("l_quantity")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("l_suppkey").alias("competitor_id"), F.col("l_partkey").alias("service_id"), F.col("p_name").alias("service_name"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"),
        base.alias("price"), F.col("l_discount").alias("discount"), F.to_date("l_shipdate").alias("day"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"),
    )


def offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """competitor_id, service_id: each pair once."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("competitor_id"), F.col("l_partkey").alias("service_id")).distinct()


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, part = offered(spark, sf_dir), table(spark, sf_dir, "part")
    return pairs.join(part, pairs.service_id == part.p_partkey).select("competitor_id", "service_id", F.col("p_name").alias("service_name"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"))


def collection_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("log_id"), F.col("o_custkey").alias("competitor_id"), F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "O").alias("success"), F.col("o_totalprice").alias("records"))


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("competitor_id"), F.col("event_type").alias("kind"), "ts", F.to_date("ts").alias("day"), "value", "props")
