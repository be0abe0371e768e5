"""Schemas, feature names and configuration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Trailing count-window lengths and the nine per-window features.
WINDOWS = (1, 3, 5, 10, 20, 50, 100, 500)
BASE_FEATURES = (
    "AvgAmountT", "TotalAmountT", "StdAmountT", "BiasAmountT", "NumberT",
    "UniqueDestinationT", "UniquePurposeT", "UniqueStatusT", "TradingEntropyT",
)

LEDGER = T.StructType([
    T.StructField("txn_id", T.StringType()),
    T.StructField("txn_time", T.TimestampType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("destination_id", T.StringType()),
    T.StructField("status", T.BooleanType()),
    T.StructField("purpose", T.StringType()),
])

_CATEGORY = T.MapType(T.StringType(), T.StructType([
    T.StructField("prob", T.StringType()),
    T.StructField("volume", T.LongType()),
    T.StructField("relative_error", T.StringType()),
    T.StructField("sampling_ratio", T.DoubleType()),
    T.StructField("total_sample_size", T.LongType()),
]))

PROFILE = T.StructType([
    T.StructField("temporal_heatmap", T.StructType([
        T.StructField("heatmap", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("sampling_error", T.DoubleType()),
        T.StructField("confidence_level", T.DoubleType()),
    ])),
    T.StructField("categorical_weights", T.MapType(T.StringType(), _CATEGORY)),
    T.StructField("monetary_distribution", T.StructType([
        T.StructField("pareto_alpha", T.DoubleType()),
        T.StructField("tail_threshold", T.DoubleType()),
    ])),
    T.StructField("graph_topology", T.StructType([
        T.StructField("user_degree_pareto_alpha", T.DoubleType()),
    ])),
])


@dataclass(frozen=True)
class ProfileConfig:
    """What the profile step reads; window_start, seed and, if given, the time of extraction are explicit so that runs repeat."""

    window_start: str
    timezone: str = "Asia/Kathmandu"
    sample_fraction: float | None = None
    seed: int = 42
    top: int = 10
    window_days: int = 14
    extracted_at: str | None = None
    method: str = "exact"
    categories: tuple[str, ...] = ("is_obsolete", "purpose")


@dataclass(frozen=True)
class SynthConfig:
    num_users: int = 1000
    num_days: int = 30
    seed: int = 42
    cluster: int = 100
    in_cluster: float = 0.999
    calibrated: bool = True
    partitions: int = 8
