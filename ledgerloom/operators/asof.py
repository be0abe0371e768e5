"""Graph features as of just before each transaction: running windows and births, no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .temporal import running_sums

KEY = ("txn_time", "txn_id")


def first_contact(df: DataFrame) -> DataFrame:
    """df plus `new_edge`: 1 on a pair's first transaction."""
    pair = Window.partitionBy("source_id", "destination_id").orderBy(*KEY)
    return df.withColumn("new_edge", (F.row_number().over(pair) == 1).cast("long"))


def degree_features(df: DataFrame, hub: int | None = 1_000_000) -> DataFrame:
    """C1-C4, C7-C9, C13 from two running windows; either end may be a hub."""
    own = df.columns
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    df = running_sums(first_contact(df), "source_id", {"_new_out": F.col("new_edge"), "_out": F.col("amount"), "_n_out": F.when(F.col("amount").isNotNull(), one)}, hub)
    df = running_sums(df, "destination_id", {"_new_in": F.col("new_edge"), "_in": F.col("amount")}, hub)
    return df.select(
        *own, "new_edge",
        F.coalesce("_new_out", zero).alias("out_degree_source"),
        F.coalesce("_out", F.lit(0.0)).alias("weighted_out_degree_source"),
        F.coalesce(F.col("_out") / F.col("_n_out"), F.lit(0.0)).alias("avg_neighbor_amt_source"),
        F.coalesce("_new_in", zero).alias("in_degree_destination"),
        F.coalesce("_in", F.lit(0.0)).alias("weighted_in_degree_destination"),
        F.coalesce("_new_out", zero).alias("num_unique_neighbors_source"),
        F.col("new_edge").alias("ratio_new_neighbors"),
        (1 - F.col("new_edge")).alias("edge_recurrence"))


def node_events(df: DataFrame) -> DataFrame:
    """One row for each (node, transaction): is_src, is_dst and weight, 2 on a self-loop."""
    return df.selectExpr("txn_id", "txn_time", """inline(if(source_id = destination_id,
        array(named_struct('node', source_id, 'is_src', true, 'is_dst', true, 'weight', 2L)),
        array(named_struct('node', source_id, 'is_src', true, 'is_dst', false, 'weight', 1L),
              named_struct('node', destination_id, 'is_src', false, 'is_dst', true, 'weight', 1L))))""")


def participation(df: DataFrame, hub: int | None = 1_000_000) -> DataFrame:
    """C5 and C6: prior transactions of either end in either role; a node may be a hub."""
    events = running_sums(node_events(df), "node", {"_prior": F.col("weight")}, hub).withColumn("prior", F.coalesce("_prior", F.lit(0).cast("long")))
    return events.groupBy("txn_id").agg(
        F.max(F.when(F.col("is_src"), F.col("prior"))).alias("total_txns_source"),
        F.max(F.when(F.col("is_dst"), F.col("prior"))).alias("total_txns_destination"))


def _births(df: DataFrame) -> DataFrame:
    """Distinct directed edges without self-loops and the key of their first transaction."""
    return (df.where("source_id <> destination_id").groupBy(F.col("source_id").alias("u"), F.col("destination_id").alias("v"))
            .agg(F.min(F.struct(*KEY)).alias("b")))


def triangle_births(edges: DataFrame) -> DataFrame:
    """(node, b, t): how many ordered triangles through a node are complete once edge birth b has come.

    Undirected pairs point from the lower degree to the higher, so that wedges stay within O(m^1.5)."""
    pairs = (edges.select(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y"), "b")
             .groupBy("x", "y").agg(F.collect_list("b").alias("bs")))
    degree = pairs.select(F.explode(F.array("x", "y")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("deg"))
    d1 = degree.select(F.col("n").alias("x"), F.col("deg").alias("dx"))
    d2 = degree.select(F.col("n").alias("y"), F.col("deg").alias("dy"))
    low = F.struct("dx", "x") < F.struct(F.col("dy").alias("dx"), F.col("y").alias("x"))
    oriented = (pairs.join(d1, "x").join(d2, "y")
                .select(F.when(low, F.col("x")).otherwise(F.col("y")).alias("lo"), F.when(low, F.col("y")).otherwise(F.col("x")).alias("hi"), F.when(low, F.struct("dy", "y")).otherwise(F.struct(F.col("dx").alias("dy"), F.col("x").alias("y"))).alias("rank"), "bs"))
    a = oriented.select("lo", F.col("hi").alias("m"), F.col("rank").alias("rm"), F.col("bs").alias("b1"))
    b = oriented.select("lo", F.col("hi").alias("k"), F.col("rank").alias("rk"), F.col("bs").alias("b2"))
    closing = oriented.select(F.col("lo").alias("m"), F.col("hi").alias("k"), F.col("bs").alias("b3"))
    closed = a.join(b, "lo").where(F.col("rm") < F.col("rk")).join(closing, ["m", "k"])
    born = closed.select("lo", "m", "k", F.explode(F.flatten(F.transform("b1", lambda p: F.flatten(F.transform("b2", lambda q: F.transform("b3", lambda r: F.greatest(p, q, r))))))).alias("b"))
    return (born.groupBy("lo", "m", "k", "b").agg(F.count(F.lit(2)).alias("c"))
            .select(F.explode(F.array("lo", "m", "k")).alias("node"), "b", (2 * F.col("c")).alias("t"))
            .groupBy("node", "b").agg(F.sum("t").alias("t")))


def node_births(edges: DataFrame) -> DataFrame:
    """(node, b, t, d, r): what each birth adds to a node's triangles, degree and reciprocated neighbours."""
    zero = F.lit(0).cast("long")
    tri = triangle_births(edges).select("node", "b", "t", zero.alias("d"), zero.alias("r"))
    deg = edges.select(F.explode(F.array("u", "v")).alias("node"), "b", zero.alias("t"), F.lit(1).cast("long").alias("d"), zero.alias("r"))
    both = edges.alias("e").join(edges.alias("f"), (F.col("e.u") == F.col("f.v")) & (F.col("e.v") == F.col("f.u")))
    rec = both.select(F.col("e.u").alias("node"), F.greatest("e.b", "f.b").alias("b"), zero.alias("t"), zero.alias("d"), F.lit(1).cast("long").alias("r"))
    return tri.unionByName(deg).unionByName(rec)


def _coefficient():
    d, r, t = F.col("d"), F.col("r"), F.col("t")
    return F.when((t > 0) & (d * (d - 1) - 2 * r > 0), t / (2 * (d * (d - 1) - 2 * r))).otherwise(0.0)


def clustering_asof(df: DataFrame) -> DataFrame:
    """C12: txn_id and the source's directed clustering strictly before each transaction. Queries sort before births of the same key."""
    births = node_births(_births(df)).groupBy("node", "b").agg(*[F.sum(c).alias(c) for c in "tdr"])
    zero = F.lit(0).cast("long")
    rows = births.withColumn("kind", F.lit(1)).unionByName(df.select(F.col("source_id").alias("node"), F.struct(*KEY).alias("b"), *[zero.alias(c) for c in "tdr"], F.lit(0).alias("kind")))
    before = Window.partitionBy("node").orderBy("b", "kind").rowsBetween(Window.unboundedPreceding, -1)
    state = rows.withColumns({c: F.coalesce(F.sum(c).over(before), zero) for c in "tdr"})
    return state.where("kind = 0").select(F.col("b.txn_id").alias("txn_id"), _coefficient().alias("clustering_coeff_source"))


def clustering_final(df: DataFrame) -> DataFrame:
    """Directed clustering of every node in the whole graph."""
    total = node_births(_births(df)).groupBy("node").agg(*[F.sum(c).alias(c) for c in "tdr"])
    nodes = df.select(F.explode(F.array("source_id", "destination_id")).alias("node")).distinct()
    return nodes.join(total, "node", "left").na.fill(0).select("node", _coefficient().alias("clustering"))


def graph_features(df: DataFrame, ranks: DataFrame) -> DataFrame:
    """txn_id and C1-C13; `ranks` (id, pagerank) is the whole graph's, so it looks ahead by design."""
    s = ranks.select(F.col("id").alias("source_id"), F.col("pagerank").alias("pagerank_source"))
    d = ranks.select(F.col("id").alias("destination_id"), F.col("pagerank").alias("pagerank_destination"))
    base = degree_features(df).join(s, "source_id", "left").join(d, "destination_id", "left").na.fill(0.0, ["pagerank_source", "pagerank_destination"])
    return (base.join(participation(df), "txn_id").join(clustering_asof(df), "txn_id")
            .select("txn_id", "out_degree_source", "in_degree_destination", "weighted_out_degree_source", "weighted_in_degree_destination", "total_txns_source", "total_txns_destination", "num_unique_neighbors_source", "avg_neighbor_amt_source", "ratio_new_neighbors", "pagerank_source", "pagerank_destination", "clustering_coeff_source", "edge_recurrence"))
