"""Synthetic ledgers: minutes, intensities and seeded draws, all in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import category_weights, cents, draw, pareto_inverse, weighted_choice
from ..schema import SynthConfig
from ..sources import ticks, user_id


def tick_intensity(heat: DataFrame, cfg: SynthConfig, spark: SparkSession, tz: str = "UTC") -> DataFrame:
    """Expected transactions a minute from the cell's share of the heatmap; calibrated so that whole weeks add up to users * 3 * days."""
    total = heat.agg(F.sum("volume").alias("total"))
    target = cfg.num_users * 3 * cfg.num_days
    t = ticks(spark, cfg.num_days, cfg.partitions)
    local = F.from_utc_timestamp("txn_time", tz)
    t = t.withColumns({"hour": F.hour(local), "dow": F.dayofweek(local) - 1})
    lam = F.col("volume") / F.col("total") * (target / (cfg.num_days * 1440) * (168 if cfg.calibrated else 1))
    return (t.join(F.broadcast(heat.select("hour", "dow", "volume")), ["hour", "dow"]).join(F.broadcast(total))
            .select("tick", "txn_time", F.when(F.col("total") > 0, lam).otherwise(0.0).alias("lam")))


def sample_amounts(df: DataFrame, minimum: float, alpha: float, seed: int, key: str) -> DataFrame:
    return df.withColumn("amount", cents(pareto_inverse(draw(seed, F.col(key)), F.lit(minimum), F.lit(alpha))))


def pareto_degrees(users: DataFrame, alpha: float, total: int, seed: int) -> DataFrame:
    """Activity of each user, at most a tenth of all transactions."""
    return users.withColumn("num_txns", F.least(F.round(F.pow(1 / (1 - draw(seed, F.col("user_index"))), 1 / alpha)), F.lit(float(total // 10))).cast("long"))


def choose(df: DataFrame, out: str, weights: dict[str, float], seed: int, *keys: str) -> DataFrame:
    """A value drawn by weight."""
    if not weights:
        weights = {"unknown": 1.0}
    values, acc, cdf = sorted(weights), 0.0, []
    for v in values:
        acc += weights[v]
        cdf.append(acc)
    return df.withColumn(out, weighted_choice(draw(seed, *[F.col(k) for k in keys]), F.array(*map(F.lit, values)), F.array(*map(F.lit, cdf))))


def destinations(source: Column, cfg: SynthConfig, *keys: Column) -> Column:
    """Mostly a user of the source's own block of `cluster` users, always where there is only one block, else any; a payment to oneself goes to the next user."""
    n = cfg.num_users
    block = F.floor(source / cfg.cluster) * cfg.cluster
    near = (block + F.floor(draw(cfg.seed + 5, *keys) * cfg.cluster)) % n
    far = F.floor(draw(cfg.seed + 6, *keys) * n)
    d = near if n <= cfg.cluster else F.when(draw(cfg.seed + 4, *keys) < cfg.in_cluster, near).otherwise(far)
    return F.when(d == source, (d + 1) % n).otherwise(d).cast("long")


def first_numbers(ticks_: DataFrame) -> DataFrame:
    """ticks_(tick, n) plus `first`: transactions before each minute. Days are summed apart, so no window spans more than the days or a day's minutes, and ledger rows need none."""
    day = F.floor(F.col("tick") / 1440)
    t = ticks_.withColumn("_day", day)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    days = t.groupBy("_day").agg(F.sum("n").alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(before(Window.orderBy("_day"))), F.lit(0)))
    within = F.coalesce(F.sum("n").over(before(Window.partitionBy("_day").orderBy("tick"))), F.lit(0))
    return t.withColumn("first", within).join(F.broadcast(days.select("_day", "_off")), "_day").withColumn("first", F.col("first") + F.col("_off")).drop("_day", "_off")


def synthesize(spark: SparkSession, heat: DataFrame, cfg: SynthConfig, *, minimum: float, alpha: float, status: dict[str, float], purpose: dict[str, float], tz: str = "UTC") -> DataFrame:
    """The ledger: minutes with floor(lambda) transactions and one more by chance, then seeded draws for every column."""
    lam = tick_intensity(heat, cfg, spark, tz)
    whole = F.floor("lam")
    n = whole + (draw(cfg.seed, F.col("tick")) < F.col("lam") - whole).cast("long")
    rows = first_numbers(lam.withColumn("n", n)).where("n > 0").select("tick", "txn_time", "first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("seq"))
    keys = [F.col("tick"), F.col("seq")]
    rows = rows.withColumn("src", F.floor(draw(cfg.seed + 1, *keys) * cfg.num_users))
    rows = rows.withColumn("dst", destinations(F.col("src"), cfg, *keys)).withColumn("amount", cents(pareto_inverse(draw(cfg.seed + 2, *keys), F.lit(minimum), F.lit(alpha))))
    rows = choose(choose(rows, "status", status, cfg.seed + 7, "tick", "seq"), "purpose", purpose, cfg.seed + 8, "tick", "seq")
    txn_id = F.format_string("TXN_%010d", (F.col("first") + F.col("seq") - 1).cast("long")).alias("txn_id")
    return rows.select(txn_id, "txn_time", "amount", user_id(F.col("src")).alias("source_id"), user_id(F.col("dst")).alias("destination_id"), F.expr("try_cast(status AS boolean)").alias("status"), "purpose")


def from_profile(spark: SparkSession, profile: DataFrame, cfg: SynthConfig) -> DataFrame:
    """Synthesis from a one-row profile document; an error document raises."""
    doc = profile.select("temporal_heatmap.heatmap", F.col("monetary_distribution.pareto_alpha").alias("alpha"), F.col("monetary_distribution.tail_threshold").alias("minimum"),
        category_weights(F.col("categorical_weights")["gateway_transaction.is_obsolete"]).alias("status"), category_weights(F.col("categorical_weights")["gateway_transaction.purpose"]).alias("purpose")).first()
    if doc is None or doc["heatmap"] is None or doc["alpha"] is None or "error" in doc["status"] or "error" in doc["purpose"]:
        raise ValueError("the profile document is incomplete or holds an error")
    heat = profile.select(F.posexplode("temporal_heatmap.heatmap").alias("hour", "days")).select("hour", F.posexplode("days").alias("dow", "volume"))
    return synthesize(spark, heat, cfg, minimum=doc["minimum"], alpha=doc["alpha"], status=doc["status"], purpose=doc["purpose"])
