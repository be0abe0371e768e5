"""Writers for ledgers, features, tensors and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV; arrays are JSON text, times are RFC 3339 with a numeric offset, and with microseconds where there are any."""
    def time(c: str):
        whole = F.unix_micros(c) % 1_000_000 == 0
        return F.when(whole, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")).alias(c)

    cols = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else time(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").csv(path, header=True)


def write_features(df: DataFrame, path: str) -> None:
    """Parquet by day of the transaction, so that later reads prune."""
    df.withColumn("txn_date", F.to_date("txn_time")).write.mode("overwrite").partitionBy("txn_date").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """One JSON document a row."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def save_npy(df: DataFrame, tensor_path: str, label_path: str, limit: int = 2_000_000) -> None:
    """Tensor (N, F, W) and labels as .npy on the driver; refuses frames over `limit` rows."""
    import numpy as np

    if (n := df.count()) > limit:
        raise ValueError(f"{n} rows exceed the driver limit of {limit}; keep the parquet tensor")
    rows = df.orderBy("txn_time", "txn_id").select("tensor", "label").toPandas()
    np.save(tensor_path, np.array([[list(p) for p in t] for t in rows["tensor"]], dtype="float64"))
    np.save(label_path, rows["label"].to_numpy())
