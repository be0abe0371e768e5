"""Trailing count-window features: one exchange and one sort on the source serve every frame. Hub sources are cut into blocks of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import entropy, purpose_sums
from ..schema import BASE_FEATURES, WINDOWS

ORDER = ("txn_time", "txn_id")
#: At most so many hubs are split, so that their list may be broadcast; any other source has a share of 1 / MOST_HUBS of the rows at most.
MOST_HUBS, MOST_CUTS = 4096, 1024


def preprocess(df: DataFrame, lenient: bool = False) -> DataFrame:
    """Parsed time, `Unknown` for null purposes and an integer status; text that is no status raises unless lenient."""
    status = F.expr("try_cast(status AS int)") if lenient else F.col("status").cast("int")
    return df.withColumns({"txn_time": F.to_timestamp("txn_time"), "purpose": F.coalesce("purpose", F.lit("Unknown")), "status_int": status})


def since(df: DataFrame, time: str, start: str | Column) -> Column:
    return F.col(time) >= F.lit(start).cast("timestamp_ntz" if dict(df.dtypes)[time] == "timestamp_ntz" else "timestamp")


def recent(df: DataFrame, time: str, start: str | Column, amount: str = "amount") -> DataFrame:
    """Positive amounts since `start`."""
    return df.where(since(df, time, start) & (F.col(amount) > 0))


def _frame(w: int, keys: tuple[str, ...] = ("source_id",)):
    return Window.partitionBy(*keys).orderBy(*ORDER).rowsBetween(-w, -1)


def split_hubs(df: DataFrame, longest: int, hub: int, key: str = "source_id") -> DataFrame | None:
    """df plus `_part`, `_lead` and `_split`, the rows of keys above `hub` rows dealt by rank; None if there is no such key.

    A part holds consecutive rows of one key, headed by the `longest` rows before it, marked `_lead`, so a trailing frame
    never reaches past its part and lead rows are dropped after use. Ranks need no task that holds a key: approximate cuts
    of time, common to all hubs, bound each (key, cut) by a share of the rows, and counts of those give where each begins.
    Rows of one time stay in one cut. txn_id must be unique under a key, as for the windows themselves. Rows of other keys
    are not `_split`."""
    counted = df.groupBy(F.col(key).alias("_hub")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hub)
    found = counted.orderBy(F.desc("_n"), "_hub").limit(MOST_HUBS).collect()
    if not found:
        return None
    size = max(hub // 4, longest, 1)
    hubs = F.broadcast(df.sparkSession.createDataFrame([(r["_hub"],) for r in found], counted.select("_hub").schema))
    is_hub = F.col(key).eqNullSafe(F.col("_hub"))
    hot, cold = df.join(hubs, is_hub, "left_semi"), df.join(hubs, is_hub, "left_anti")
    k = min(MOST_CUTS, -(-sum(r["_n"] for r in found) // size))
    cuts = hot.agg(F.percentile_approx("txn_time", [i / k for i in range(1, k)] or [0.5], max(10_000, 20 * k)).alias("_cuts"))
    hot = hot.crossJoin(F.broadcast(cuts)).withColumn("_cut", F.size(F.filter("_cuts", lambda c: c <= F.col("txn_time")))).drop("_cuts")
    starts = hot.groupBy(F.col(key).alias("_hub"), F.col("_cut").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_hub").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_hub", "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(key, "_cut").orderBy(*ORDER)) - 1
    ranked = hot.withColumn("_place", place).join(starts, is_hub & (F.col("_cut") == F.col("_at"))).withColumn("_rank", F.col("_start") + F.col("_place"))
    own = F.floor(F.col("_rank") / size)
    dealt = F.when(F.col("_rank") % size >= size - longest, F.array(own, own + 1)).otherwise(F.array(own))
    hot = ranked.withColumn("_own", own).withColumn("_part", F.explode(dealt)).withColumn("_lead", F.col("_part") > F.col("_own"))
    return (hot.select(*df.columns, "_part", "_lead", F.lit(True).alias("_split"))
            .unionByName(cold.select(*df.columns, F.lit(0).cast("long").alias("_part"), F.lit(False).alias("_lead"), F.lit(False).alias("_split"))))


def running_sums(df: DataFrame, key: str, sums: dict[str, Column], hub: int | None = 1_000_000) -> DataFrame:
    """df plus each sum over all rows before the current one under `key`, null where there is none.

    Keys above `hub` rows are split: each part opens with one row that carries the sums of the parts before it, so no task
    holds a hub and no join is needed."""
    valued = df.withColumns({f"_v_{n}": c for n, c in sums.items()})
    parts = split_hubs(valued, 0, hub, key) if hub is not None else None
    if parts is None:
        before = Window.partitionBy(key).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
        return valued.select(*df.columns, *[F.sum(f"_v_{n}").over(before).alias(n) for n in sums])
    totals = parts.where("_split").groupBy(key, "_part").agg(*[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in sums])
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    opening = totals.select(key, "_part", *[F.sum(f"_v_{n}").over(earlier).alias(f"_v_{n}") for n in sums], F.lit(0).alias("_row"))
    rows = parts.withColumn("_row", F.lit(1)).unionByName(opening, allowMissingColumns=True)
    before = Window.partitionBy(key, "_part").orderBy("_row", *ORDER).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*df.columns, "_row", *[F.sum(f"_v_{n}").over(before).alias(n) for n in sums]).where("_row = 1").drop("_row")


def window_feature(base: str, w: int, keys: tuple[str, ...] = ("source_id",)) -> Column:
    """One of the first eight features; an empty frame gives 0."""
    f, amount = _frame(w, keys), F.col("amount")
    n = F.count(F.lit(1)).over(f)

    def distinct(c: str) -> Column:
        return F.size(F.collect_set(c).over(f)).cast("long")

    return {
        "AvgAmountT": lambda: F.coalesce(F.avg(amount).over(f), F.lit(0.0)),
        "TotalAmountT": lambda: F.coalesce(F.sum(amount).over(f), F.lit(0.0)),
        "StdAmountT": lambda: F.coalesce(F.stddev_pop(amount).over(f), F.lit(0.0)),
        "BiasAmountT": lambda: F.when(n > 0, amount - F.avg(amount).over(f)).otherwise(0.0),
        "NumberT": lambda: n,
        "UniqueDestinationT": lambda: distinct("destination_id"),
        "UniquePurposeT": lambda: distinct("purpose"),
        "UniqueStatusT": lambda: F.coalesce(F.when(F.max("status_int").over(f) != F.min("status_int").over(f), 2).when(n > 0, 1), F.lit(0)).cast("long"),
    }[base]()


def domain(df: DataFrame, column: str = "purpose", most: int = 16) -> list | None:
    """The values of a column if there are at most `most`, else None."""
    found = [r[0] for r in df.select(column).distinct().limit(most + 1).collect()]
    return sorted(v for v in found if v is not None) if len(found) <= most and None not in found else None


def temporal_features(df: DataFrame, windows: tuple[int, ...] = WINDOWS, bases: tuple[str, ...] = BASE_FEATURES, purposes: list | None = None, hub: int | None = 1_000_000) -> DataFrame:
    """df plus `{base}_{w}` columns.

    Entropies are sums per purpose over the same frames where the set of purposes is small: `purposes` gives it, or it is read
    off df. Beyond that they share one collected frame of the longest window, cut per w. Sources above `hub` rows are split,
    which one count per source decides; None skips the count."""
    names = [f"{b}_{w}" for b in [b for b in bases if b != "TradingEntropyT"] + [b for b in bases if b == "TradingEntropyT"] for w in windows]
    known = (purposes or domain(df)) if "TradingEntropyT" in bases else None
    if hub is not None and windows and (parts := split_hubs(df, max(windows), hub)) is not None:
        return _features(parts, windows, bases, known, ("source_id", "_part")).where("not _lead").select(*df.columns, *names)
    return _features(df, windows, bases, known, ("source_id",)).select(*df.columns, *names)


def _features(df: DataFrame, windows: tuple[int, ...], bases: tuple[str, ...], known: list | None, keys: tuple[str, ...]) -> DataFrame:
    plain = {f"{b}_{w}": window_feature(b, w, keys) for b in bases if b != "TradingEntropyT" for w in windows}
    if "TradingEntropyT" not in bases:
        return df.withColumns(plain)
    if known:
        own = df.columns
        for w in windows:
            df = entropy_sums(df, w, known, keys)
        out = df.withColumns(plain | {f"_n{w}": F.count(F.lit(1)).over(_frame(w, keys)) for w in windows})
        return out.select(*own, *plain, *[entropy_from_sums(w, known).alias(f"TradingEntropyT_{w}") for w in windows])
    items = F.collect_list(F.struct("purpose", "amount")).over(_frame(max(windows), keys))
    out = df.withColumns(plain | {"_items": items})
    return out.withColumns({f"TradingEntropyT_{w}": _entropy_change(w) for w in windows}).drop("_items")


def _entropy_change(w: int) -> Column:
    """H(frame) - H(frame with the current row), from the frame's sums per purpose; 0 on an empty frame or without a positive total."""
    tail = f"slice(_items, greatest(1, size(_items) - {w - 1}), {w})"
    with_current = f"concat({tail}, array(named_struct('purpose', purpose, 'amount', amount)))"
    return F.expr(f"if(size(_items) = 0, 0D, {entropy(tail)} - {entropy(with_current)})")


def entropy_by_domain(df: DataFrame, w: int, purposes: list[str]) -> DataFrame:
    """TradingEntropyT_w by conditional sums, for a small known set of purposes that covers the column: no arrays."""
    own = df.columns
    df = entropy_sums(df, w, purposes).withColumn(f"_n{w}", F.count(F.lit(1)).over(_frame(w)))
    return df.select(*own, entropy_from_sums(w, purposes).alias(f"TradingEntropyT_{w}"))


def entropy_sums(df: DataFrame, w: int, purposes: list[str], keys: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """df plus `_s{w}_{i}`: the frame's amount under each purpose."""
    f = _frame(w, keys)
    return df.withColumns({f"_s{w}_{i}": F.coalesce(F.sum(F.when(F.col("purpose") == p, F.col("amount"))).over(f), F.lit(0.0)) for i, p in enumerate(purposes)})


def entropy_from_sums(w: int, purposes: list[str]) -> Column:
    """H(frame) - H(frame with the current row) from `_s{w}_{i}` and the frame's row count `_n{w}`."""

    def h(parts: list[Column]) -> Column:
        total = sum(parts, F.lit(0.0))
        q = sum((F.when(x > 0, x * F.ln(x)).otherwise(0.0) for x in parts), F.lit(0.0))
        return F.when(total > 0, F.ln(total) - q / total).otherwise(0.0)

    before = [F.col(f"_s{w}_{i}") for i in range(len(purposes))]
    after = [b + F.when(F.col("purpose") == p, F.col("amount")).otherwise(0.0) for b, p in zip(before, purposes, strict=True)]
    return F.when(F.col(f"_n{w}") > 0, h(before) - h(after)).otherwise(0.0)


def tensor(df: DataFrame, windows: tuple[int, ...] = WINDOWS, bases: tuple[str, ...] = BASE_FEATURES, compat: bool = False) -> DataFrame:
    """txn_id, txn_time, `tensor` array<array<double>> (features by windows) and `label`; compat repeats the planes three times."""
    planes = [F.array(*[F.col(f"{b}_{w}").cast("double") for w in windows]) for b in bases]
    return df.select("txn_id", "txn_time", F.array(*(planes * (3 if compat else 1))).alias("tensor"), F.col("status_int").alias("label"))


__all__ = ["preprocess", "since", "recent", "domain", "split_hubs", "running_sums", "temporal_features", "tensor", "entropy_by_domain", "purpose_sums"]
