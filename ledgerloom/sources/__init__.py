"""Scans, samples and generators that feed the engine."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draw
from ..runtime import table
from ..schema import LEDGER, PROFILE

# Fixed value: 2024-01-01T00:00:00Z, the first simulated minute.
EPOCH = 1_704_067_200


def read_ledger_csv(spark: SparkSession, path: str, null_tokens: tuple[str, ...] = ()) -> DataFrame:
    """Ledger CSV with header under an explicit schema; null_tokens in purpose read as null."""
    df = spark.read.csv(path, header=True, schema=LEDGER)
    if null_tokens:
        df = df.withColumn("purpose", F.when(~F.col("purpose").isin(*null_tokens), F.col("purpose")))
    return df


def read_jdbc(spark: SparkSession, url: str, dbtable: str, *, column: str | None = None, bounds: tuple[str, str] | None = None, partitions: int = 8, timeout: int = 3600, **options: str) -> DataFrame:
    """Read-only JDBC scan, split on `column` between `bounds`."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=dbtable, queryTimeout=str(timeout), pushDownTableSample="true", **options)
    if url.startswith("jdbc:postgresql"):
        reader = reader.option("sessionInitStatement", "SET default_transaction_read_only = on")
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=str(partitions))
    return reader.load()


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """One-row profile document; probabilities may be text or numbers."""
    return spark.read.schema(PROFILE).json(path, multiLine=True)


def events_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a ledger: users pay the id in `props.k`."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("txn_id"),
        F.col("ts").alias("txn_time"),
        F.col("value").alias("amount"),
        F.col("user_id").alias("source_id"),
        F.get_json_object("props", "$.k").cast("long").alias("destination_id"),
        F.col("event_type").alias("purpose"),
        (F.col("event_id") % 3 == 0).cast("int").alias("status_int"),
    )


def events_gateway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table under the profiled source table's column names."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("created_on"),
        F.col("value").alias("amount"),
        (F.col("event_id") % 10 == 0).alias("is_obsolete"),
        F.col("event_type").alias("purpose"),
        F.col("user_id").alias("source_id"),
    )


def orders_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers pay suppliers, one transaction a line item."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("txn_id"),
        F.col("l_shipdate").alias("txn_time"),
        F.col("l_extendedprice").alias("amount"),
        F.col("o_custkey").alias("source_id"),
        F.col("l_suppkey").alias("destination_id"),
        F.col("l_returnflag").alias("purpose"),
        (F.col("l_linestatus") == "F").cast("int").alias("status_int"),
    )


def sampled(df: DataFrame, fraction: float | None, seed: int, *key: str) -> DataFrame:
    """Seeded Bernoulli row sample; None reads everything. With key columns the draw hangs on them alone, not on how rows are partitioned."""
    if fraction is None:
        return df
    return df.where(draw(seed, *[F.col(k) for k in key]) < fraction) if key else df.sample(withReplacement=False, fraction=fraction, seed=seed)


def sample_size(n: int, ratio: float, min_sample: int, z: float = 1.96, margin: float = 0.01) -> int:
    """Rows to draw out of n: all of a small table, else the ratio capped by the binomial bound."""
    return n if n < min_sample else min(int(n * ratio), math.floor(z * z * 0.25 / margin**2))


def table_statistics(df: DataFrame) -> DataFrame:
    """The optimizer's cost text for df, one row."""
    text = df._jdf.queryExecution().optimizedPlan().stats().simpleString()
    return df.sparkSession.range(1).select(F.lit(text).alias("statistics"))


def ticks(spark: SparkSession, num_days: int, partitions: int = 8) -> DataFrame:
    """One row a simulated minute."""
    return spark.range(0, num_days * 1440, 1, partitions).select(
        F.col("id").alias("tick"), F.timestamp_seconds(F.lit(EPOCH) + F.col("id") * 60).alias("txn_time"))


def user_id(index: Column) -> Column:
    return F.format_string("u_%06d", index)


def users(spark: SparkSession, num_users: int, cluster: int = 100, partitions: int = 8) -> DataFrame:
    return spark.range(0, num_users, 1, partitions).select(
        F.col("id").alias("user_index"), user_id(F.col("id")).alias("user_id"), F.floor(F.col("id") / cluster).cast("long").alias("cluster_id"))
