"""Profile of a transaction table: heatmap, categories, Pareto tail, degrees."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import draw, local_dow, local_hour
from ..schema import ProfileConfig
from ..sources import sampled

# What the steps are called, in lower case and with underscores, where one fails.
TITLES = {
    "metadata": "Connecting to DB...",
    "temporal_heatmap": "Building temporal heatmap (streaming)...",
    "categorical_weights": "Weighting categoricals (stratified)...",
    "monetary_distribution": "Calculating monetary Pareto (reservoir)...",
    "graph_topology": "Capturing graph topology (HyperLogLog)...",
}


def heatmap(df: DataFrame, tz: str) -> DataFrame:
    """Rows by local hour and weekday (0 is Sunday)."""
    return df.where("created_on is not null").groupBy(local_hour(F.col("created_on"), tz).alias("hour"), local_dow(F.col("created_on"), tz).alias("dow")).agg(F.count(F.lit(1)).alias("volume"))


def dense_heatmap(h: DataFrame) -> DataFrame:
    """All 24 x 7 cells, absent ones 0."""
    grid = h.sparkSession.range(168).select(F.floor(F.col("id") / 7).cast("int").alias("hour"), (F.col("id") % 7).cast("int").alias("dow"))
    return grid.join(h, ["hour", "dow"], "left").na.fill(0, ["volume"])


def packed_heatmap(h: DataFrame) -> DataFrame:
    """One row: array of 24 arrays of 7."""
    rows = dense_heatmap(h).groupBy("hour").agg(F.transform(F.array_sort(F.collect_list(F.struct("dow", "volume"))), lambda x: x["volume"]).alias("days"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("hour", "days"))), lambda x: x["days"]).alias("heatmap"))


def categorical(df: DataFrame, column: str, top: int = 10, min_sample: int | None = None) -> DataFrame:
    """Most frequent values: share among all groups, volume and the spread of group counts relative to the count."""
    kept = df.where(F.col(column).isNotNull())
    if min_sample is not None:
        kept = kept.limit(min_sample)
    g = kept.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("volume"))
    stats = g.agg(F.sum("volume").alias("total"), F.stddev_samp("volume").alias("sd"))
    return (g.join(F.broadcast(stats)).select(F.lit(column).alias("column"), "value", (F.col("volume") / F.col("total")).alias("prob"), "volume", F.coalesce(F.col("sd") / F.col("volume"), F.lit(0.0)).alias("relative_error"))
            .orderBy(F.desc("volume"), "value").limit(top))


def percentile(df: DataFrame, q: float = 0.95, column: str = "amount", out: str = "p95", limit: int = 100_000, bins: int = 1024) -> DataFrame:
    """Exact interpolated quantile, one row, null without values.

    Passes of `bins` counters, merged map-side, narrow the range around the two ranks until at most `limit` values are left, so
    no reducer ever holds all values; each pass narrows the range by a factor of bins / 2 at least."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    n, lo, hi = x.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    rank, below, inside, found = (n - 1) * q, 0, n, (lo, lo)
    first, last = math.floor(rank), math.ceil(rank)
    while n and lo < hi:
        part = x.where(F.col("x").between(lo, hi))
        if inside <= limit:
            values = sorted(r.x for r in part.collect())
            found = values[first - below], values[last - below]
            break
        step = F.least(F.lit(bins - 1), F.floor((F.col("x") - lo) / (hi - lo) * bins))
        rows = sorted(part.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect())
        ends = list(accumulate(r.n for r in rows))
        a, b = (next(i for i, e in enumerate(ends) if below + e > r) for r in (first, last))
        found = rows[a].lo, rows[b].hi
        if all(rows[i].lo == rows[i].hi for i in (a, b)):
            break
        lo, hi, inside, below = rows[a].lo, rows[b].hi, ends[b] - ends[a] + rows[a].n, below + ends[a] - rows[a].n
    else:
        found = lo, lo
    value = None if not n else found[0] + (found[1] - found[0]) * (rank - first)
    return df.sparkSession.range(0, 1, 1, 1).select(F.lit(value).cast("double").alias(out))


def tail(df: DataFrame, q: float = 0.95) -> DataFrame:
    """Rows at or above the quantile: a one-row broadcast and a filter."""
    return df.join(F.broadcast(percentile(df, q))).where("amount >= p95")


def tail_stats(t: DataFrame) -> DataFrame:
    return t.agg(F.count(F.lit(1)).alias("n"), F.sum(F.ln(F.col("amount") / F.col("p95"))).alias("sum_ln"), F.min("amount").alias("min"), F.max("amount").alias("max"), F.avg("amount").alias("mean"), F.max("p95").alias("threshold"))


def pareto_fit(stats: DataFrame) -> DataFrame:
    """Density exponent 1 + n / sum ln(x / x_min) with its normal interval, and the survival exponent beside it; 0 without spread."""
    ok = F.col("sum_ln") > 0
    alpha = F.when(ok, 1 + F.col("n") / F.col("sum_ln")).otherwise(0.0)
    se = F.when(ok, alpha / F.sqrt("n")).otherwise(0.0)
    return stats.select(alpha.alias("pareto_alpha"), (alpha - 1.96 * se).alias("alpha_ci_lower"), (alpha + 1.96 * se).alias("alpha_ci_upper"), F.when(ok, alpha - 1).otherwise(0.0).alias("survival_alpha"),
        "threshold", F.col("n").alias("tail_count"), "min", "max", "mean")


def reservoir(df: DataFrame, k: int, seed: int, *key: str) -> DataFrame:
    """k rows drawn uniformly: a bounded heap a partition. With key columns the draw hangs on them alone."""
    r = draw(seed, *[F.col(c) for c in key]) if key else F.rand(seed)
    return df.withColumn("_r", r).orderBy("_r", *key).limit(k).drop("_r")


def source_degrees(df: DataFrame) -> DataFrame:
    return df.groupBy("source_id").agg(F.count(F.lit(1)).alias("tx_count"))


def degree_stats(df: DataFrame) -> DataFrame:
    d = source_degrees(df)
    return d.agg(F.count(F.lit(1)).alias("users"), F.sum("tx_count").alias("transactions"), F.sum(F.ln("tx_count")).alias("sum_ln")).join(F.broadcast(percentile(d, 0.5, "tx_count", "median")))


def degree_alpha(df: DataFrame) -> DataFrame:
    d = source_degrees(df).agg(F.count(F.lit(1)).alias("users"), F.sum(F.ln("tx_count")).alias("sum_ln"))
    return d.select("users", F.when(F.col("sum_ln") > 0, 1 + F.col("users") / F.col("sum_ln")).otherwise(0.0).alias("user_degree_pareto_alpha"))


def degree_sketch(df: DataFrame) -> DataFrame:
    """Distinct sources by a mergeable sketch beside the moments of all their degrees; the exponent is 0 at a mean of 1 or less."""
    users = df.agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.col("source_id"), F.lit(14))).alias("approx_users"))
    d = source_degrees(df).agg(F.count(F.lit(1)).alias("users"), F.avg("tx_count").alias("avg_degree"), F.stddev_samp("tx_count").alias("sd_degree"))
    return users.join(F.broadcast(d)).withColumn("user_degree_pareto_alpha", F.when(F.col("avg_degree") > 1, 1 + 1 / F.ln("avg_degree")).otherwise(0.0))


def topology(df: DataFrame, method: str = "exact") -> DataFrame:
    """The degree exponent from all degrees (`exact`) or from their mean beside a sketch (`hll`): an argument takes the place of a probe for an extension."""
    if method not in ("exact", "hll"):
        raise ValueError(f"no such method: {method}")
    return (degree_sketch(df) if method == "hll" else degree_alpha(df)).select("user_degree_pareto_alpha", F.lit("hyperloglog" if method == "hll" else "sampling").alias("estimation_method"))


def category_report(df: DataFrame, columns: tuple[str, ...], top: int, ratio: float) -> DataFrame:
    """One row: map of `table.column` to the values' shares as text, with the sampling note under `_metadata`."""
    out = None
    for c in columns:
        rows = categorical(df, c, top)
        name = F.initcap("value") if dict(df.dtypes)[c] == "boolean" else F.col("value")
        item = F.struct(name.alias("key"), F.struct(F.format_string("%.6f", "prob").alias("prob"), F.col("volume"), F.format_string("%.4f", "relative_error").alias("relative_error"), F.lit(None).cast("double").alias("sampling_ratio"), F.lit(None).cast("long").alias("total_sample_size")).alias("value"))
        meta = F.struct(F.lit("_metadata").alias("key"), F.struct(F.lit(None).cast("string").alias("prob"), F.lit(None).cast("long").alias("volume"), F.lit(None).cast("string").alias("relative_error"), F.lit(ratio).alias("sampling_ratio"), F.sum("volume").alias("total_sample_size")).alias("value"))
        one = rows.agg(F.map_from_entries(F.concat(F.array_sort(F.collect_list(item)), F.array(meta))).alias("v")).select(F.lit(f"gateway_transaction.{c}").alias("k"), "v")
        out = one if out is None else out.unionByName(one)
    return out.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("categorical_weights"))


def profile_report(df: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """The nested one-row profile document. Every step is a lazy frame; one seeded sample feeds all of them.

    Categories count all rows since the start, whatever their amount; the other steps take positive amounts. A step whose
    query cannot be built, for want of a column say, gives `{"error": ..}` under its title and leaves its section out."""
    from .temporal import recent, since

    ratio, sampling = cfg.sample_fraction or 1.0, cfg.sample_fraction is not None
    every = sampled(df, cfg.sample_fraction, cfg.seed)
    base = lambda: recent(every, "created_on", cfg.window_start)
    stamp = F.lit(cfg.extracted_at) if cfg.extracted_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    one = df.sparkSession.range(0, 1, 1, 1)
    steps: dict[str, Callable[[], DataFrame]] = {
        "metadata": lambda: one.select(F.struct(stamp.alias("extraction_timestamp"), F.lit(cfg.window_days).alias("window_days"), F.lit(sampling).alias("sampling_used"), F.lit(ratio).alias("sample_ratio"))),
        "temporal_heatmap": lambda: packed_heatmap(heatmap(base(), cfg.timezone)).select(F.struct("heatmap", F.lit(0.01 if sampling else 0.0).alias("sampling_error"), F.lit(0.99 if sampling else 1.0).alias("confidence_level"))),
        "categorical_weights": lambda: category_report(every.where(since(every, "created_on", cfg.window_start)), cfg.categories, cfg.top, ratio),
        "monetary_distribution": lambda: pareto_fit(tail_stats(tail(base()))).select(F.struct("pareto_alpha", "alpha_ci_lower", "alpha_ci_upper", F.col("threshold").alias("tail_threshold"), F.col("tail_count").alias("tail_count_approx"), F.col("tail_count").alias("reservoir_samples"), F.struct("min", "max", "mean").alias("tail_statistics"))),
        "graph_topology": lambda: topology(base(), cfg.method).select(F.struct("user_degree_pareto_alpha", "estimation_method", F.lit("high" if sampling else "exact").alias("confidence"), F.lit(0.01 if sampling else 0.0).alias("sampling_error_margin"))),
    }
    out = None
    for name, step in steps.items():
        try:
            part = step()
        except AnalysisException as e:
            part, name = one.select(F.struct(F.lit(str(e)).alias("error"))), TITLES[name].lower().replace(" ", "_")
        part = part.toDF(name)
        out = part if out is None else out.join(F.broadcast(part))
    return out


def flat_report(report: DataFrame, categories: tuple[str, ...] = ("is_obsolete", "purpose")) -> DataFrame:
    """(section, field, value, text) of a report without errors: numbers to six decimals, words as text."""
    def rows(section: str, *fields):
        return [F.struct(F.lit(section).alias("section"), F.lit(n).alias("field"), F.round(v.cast("double"), 6).alias("value") if not text else F.lit(None).cast("double").alias("value"), (v.cast("string") if text else F.lit(None).cast("string")).alias("text")) for n, v, text in fields]

    c = F.col
    plain = [
        *rows("metadata", *[(n, c(f"metadata.{n}"), t) for n, t in (("extraction_timestamp", True), ("window_days", False), ("sampling_used", False), ("sample_ratio", False))]),
        *rows("temporal_heatmap", ("sampling_error", c("temporal_heatmap.sampling_error"), False), ("confidence_level", c("temporal_heatmap.confidence_level"), False)),
        *rows("monetary_distribution", *[(n, c(f"monetary_distribution.{n}"), False) for n in ("pareto_alpha", "alpha_ci_lower", "alpha_ci_upper", "tail_threshold", "tail_count_approx", "reservoir_samples", "tail_statistics.min", "tail_statistics.max", "tail_statistics.mean")]),
        *rows("graph_topology", ("user_degree_pareto_alpha", c("graph_topology.user_degree_pareto_alpha"), False), ("estimation_method", c("graph_topology.estimation_method"), True), ("confidence", c("graph_topology.confidence"), True), ("sampling_error_margin", c("graph_topology.sampling_error_margin"), False)),
    ]
    out = report.select(F.explode(F.array(*plain)).alias("r")).select("r.*")
    cells = report.select(F.posexplode("temporal_heatmap.heatmap").alias("hour", "days")).select("hour", F.posexplode("days").alias("dow", "volume"))
    out = out.unionByName(cells.select(F.lit("temporal_heatmap").alias("section"), F.concat_ws("/", F.col("hour").cast("string"), F.col("dow").cast("string")).alias("field"), F.col("volume").cast("double").alias("value"), F.lit(None).cast("string").alias("text")))
    for name in categories:
        key = f"gateway_transaction.{name}"
        entries = report.select(F.explode(F.col("categorical_weights")[key]).alias("k", "v"))
        each = entries.select(F.explode(F.array(*[F.struct(F.concat(F.lit(f"{name}/"), "k", F.lit(f"/{f}")).alias("field"), F.round(F.col(f"v.{f}").cast("double"), 6).alias("value")) for f in ("prob", "volume", "relative_error", "sampling_ratio", "total_sample_size")])).alias("r")).where("r.value is not null")
        out = out.unionByName(each.select(F.lit("categorical_weights").alias("section"), "r.field", "r.value", F.lit(None).cast("string").alias("text")))
    return out
