"""Composed pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import asof, graph, temporal


def feature_table(ledger: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """Ledger columns, 72 window features and 13 graph features, a row a transaction."""
    if ranks is None:
        ranks = graph.pagerank(graph.edges(ledger))
    return temporal.temporal_features(ledger).join(asof.graph_features(ledger, ranks), "txn_id")


def node_table(ledger: DataFrame) -> DataFrame:
    e = graph.edges(ledger)
    return graph.node_table(e, graph.pagerank(e))
