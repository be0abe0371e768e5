"""Named queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from . import plans
from .operators import asof, graph, profile, synth, temporal
from .runtime import scratch, table
from .schema import BASE_FEATURES, WINDOWS, ProfileConfig, SynthConfig
from .sources import events_gateway, events_ledger, orders_ledger, read_ledger_csv, read_profile, sample_size, sampled, sinks, ticks, users

TZ, START = "Asia/Kathmandu", "2024-01-16"
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LEDGER_SQL = """ledger AS (SELECT event_id AS txn_id, ts AS txn_time, value AS amount, user_id AS source_id,
 CAST(json_extract_string(props,'$.k') AS BIGINT) AS destination_id, event_type AS purpose, CAST(event_id % 3 = 0 AS INT) AS status_int FROM events)"""
GATE_SQL = "gate AS (SELECT ts AS created_on, value AS amount, event_id % 10 = 0 AS is_obsolete, event_type AS purpose, user_id AS source_id FROM events)"
EDGE_SQL = LEDGER_SQL + ", e AS (SELECT source_id, destination_id, sum(amount) AS total_amount, count(*) AS n, max(txn_time) AS last_time FROM ledger GROUP BY ALL)"
NODE_SQL = EDGE_SQL + ", nodes AS (SELECT source_id AS id FROM e UNION SELECT destination_id FROM e)"
BY_SRC = "PARTITION BY source_id ORDER BY txn_time, txn_id"
PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f
    return add


def draw_sql(seed: int, *keys: str) -> str:
    """functions.draw in SQL; keys must not be null."""
    return f"(('0x' || substr(md5('{seed}/' || {" || '/' || ".join(f'CAST({k} AS VARCHAR)' for k in keys)}), 1, 13))::BIGINT / {float(16**13)})"


def r6(*names: str):
    return [fn.r6(F.col(c)).alias(c) for c in names]


# --- scans and projections
query("src1_ledger_scan", f"WITH {LEDGER_SQL} SELECT * FROM ledger")(events_ledger)
query("src_orders_ledger", "SELECT l_orderkey * 8 + l_linenumber AS txn_id, l_shipdate AS txn_time, l_extendedprice AS amount, o_custkey AS source_id, l_suppkey AS destination_id, l_returnflag AS purpose, CAST(l_linestatus = 'F' AS INT) AS status_int FROM lineitem JOIN orders ON l_orderkey = o_orderkey")(orders_ledger)


@query("src6_sample_size", f"WITH {GATE_SQL} SELECT CAST(CASE WHEN count(*) < 1000 THEN count(*) ELSE least(floor(count(*) * 0.01), 9603) END AS BIGINT) AS n FROM gate WHERE amount > 0")
def _(s, d):
    n = events_gateway(s, d).where("amount > 0").count()
    return s.range(1).select(F.lit(sample_size(n, 0.01, 1000)).cast("long").alias("n"))


@query("src5_sampled_scan", f"SELECT ts AS created_on, value AS amount, event_id % 10 = 0 AS is_obsolete, event_type AS purpose, user_id AS source_id FROM events WHERE {draw_sql(42, 'event_id')} < 0.1")
def _(s, d):
    kept = sampled(table(s, d, "events"), 0.1, 42, "event_id")
    return kept.select(F.col("ts").alias("created_on"), F.col("value").alias("amount"), (F.col("event_id") % 10 == 0).alias("is_obsolete"), F.col("event_type").alias("purpose"), F.col("user_id").alias("source_id"))


@query("src2_csv_round_trip", "SELECT printf('TXN_%010d', event_id) AS txn_id, ts AS txn_time, value AS amount, printf('u_%06d', user_id) AS source_id, printf('u_%06d', CAST(json_extract_string(props,'$.k') AS BIGINT)) AS destination_id, event_id % 3 = 0 AS status, CASE WHEN event_type <> 'view' THEN event_type END AS purpose FROM events")
def _(s, d):
    ledger = events_ledger(s, d)
    user = lambda c: F.format_string("u_%06d", c).alias(c)
    path = scratch(s, "ledger")
    sinks.write_csv(ledger.select(F.format_string("TXN_%010d", "txn_id").alias("txn_id"), F.col("txn_time").cast("timestamp").alias("txn_time"), "amount", user("source_id"), user("destination_id"), (F.col("status_int") == 1).alias("status"), "purpose"), path)
    return read_ledger_csv(s, path, null_tokens=("view",)).withColumn("txn_time", F.col("txn_time").cast("timestamp_ntz"))


@query("src9_ticks", "SELECT CAST(range AS BIGINT) AS tick, CAST(TIMESTAMP '2024-01-01' + to_minutes(CAST(range AS INT)) AS TIMESTAMP) AS txn_time FROM range(4320)")
def _(s, d):
    return ticks(s, 3).withColumn("txn_time", F.col("txn_time").cast("timestamp_ntz"))


@query("src10_users", "SELECT CAST(range AS BIGINT) AS user_index, printf('u_%06d', range) AS user_id, CAST(range // 100 AS BIGINT) AS cluster_id FROM range(1000)")
def _(s, d):
    return users(s, 1000)


@query("p1_preprocess", "SELECT event_id, ts AS txn_time, coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END, 'Unknown') AS purpose, CAST(event_id % 3 = 0 AS INT) AS status_int FROM events")
def _(s, d):
    raw = table(s, d, "events").select("event_id", F.col("ts").alias("txn_time"), F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("purpose"), (F.col("event_id") % 3 == 0).alias("status"))
    return temporal.preprocess(raw).select("event_id", F.col("txn_time").cast("timestamp_ntz").alias("txn_time"), "purpose", "status_int")


@query("p4_recent_window_filter", f"WITH {GATE_SQL} SELECT * FROM gate WHERE created_on >= TIMESTAMP '{START}' AND amount > 0")
def _(s, d):
    return temporal.recent(events_gateway(s, d), "created_on", START)


@query("p7_not_null", f"WITH {GATE_SQL} SELECT purpose, count(*) AS n FROM gate WHERE purpose IS NOT NULL GROUP BY 1")
def _(s, d):
    return events_gateway(s, d).where(F.col("purpose").isNotNull()).groupBy("purpose").agg(F.count(F.lit(1)).alias("n"))


@query("p11_labels", f"WITH {LEDGER_SQL} SELECT txn_id, status_int AS label FROM ledger")
def _(s, d):
    return events_ledger(s, d).select("txn_id", F.col("status_int").alias("label"))


# --- trailing windows
def _frame(w: int) -> str:
    return f"OVER ({BY_SRC} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"


_WINDOW_SQL = {
    "AvgAmountT": lambda w: f"coalesce(avg(amount) {_frame(w)}, 0)",
    "TotalAmountT": lambda w: f"coalesce(sum(amount) {_frame(w)}, 0)",
    "StdAmountT": lambda w: f"coalesce(stddev_pop(amount) {_frame(w)}, 0)",
    "BiasAmountT": lambda w: f"coalesce(amount - avg(amount) {_frame(w)}, 0)",
    "NumberT": lambda w: f"count(*) {_frame(w)}",
    "UniqueDestinationT": lambda w: f"count(DISTINCT destination_id) {_frame(w)}",
    "UniquePurposeT": lambda w: f"count(DISTINCT purpose) {_frame(w)}",
    "UniqueStatusT": lambda w: f"count(DISTINCT status_int) {_frame(w)}",
}


def _is_count(base: str) -> bool:
    return base.startswith(("Number", "Unique"))


def _window_sql(base: str, windows=WINDOWS) -> str:
    one = lambda w: f"CAST({_WINDOW_SQL[base](w)} AS BIGINT)" if _is_count(base) else (f"round(round({_WINDOW_SQL[base](w)}, 9), 6) + 0.0" if base.startswith(("Avg", "Bias")) else f"round({_WINDOW_SQL[base](w)}, 6) + 0.0")
    return ", ".join(f"{one(w)} AS {base}_{w}" for w in windows)


def _entropy_sql(windows) -> str:
    """Self-join on the row number in a source, sums per purpose with and without the current row."""
    parts = [f"""h{w} AS (SELECT txn_id, CASE WHEN max(rn) = 1 THEN 0.0 ELSE sum(hb) - sum(ha) END AS h FROM (
      SELECT txn_id, max(rn) AS rn, 0.0 AS hb, CASE WHEN sum(s) > 0 THEN ln(sum(s)) - sum(CASE WHEN s > 0 THEN s * ln(s) ELSE 0 END) / sum(s) ELSE 0 END AS ha FROM
        (SELECT a.txn_id, max(a.rn) AS rn, b.purpose, sum(b.amount) AS s FROM r a JOIN r b ON a.source_id = b.source_id AND b.rn BETWEEN a.rn - {w} AND a.rn GROUP BY a.txn_id, b.purpose) GROUP BY txn_id
      UNION ALL
      SELECT txn_id, max(rn), CASE WHEN sum(s) > 0 THEN ln(sum(s)) - sum(CASE WHEN s > 0 THEN s * ln(s) ELSE 0 END) / sum(s) ELSE 0 END, 0.0 FROM
        (SELECT a.txn_id, max(a.rn) AS rn, b.purpose, sum(b.amount) AS s FROM r a JOIN r b ON a.source_id = b.source_id AND b.rn BETWEEN a.rn - {w} AND a.rn - 1 GROUP BY a.txn_id, b.purpose) GROUP BY txn_id) GROUP BY txn_id)""" for w in windows]
    cols = ", ".join(f"round(h{w}.h, 6) + 0.0 AS TradingEntropyT_{w}" for w in windows)
    return f"WITH {LEDGER_SQL}, r AS (SELECT *, row_number() OVER ({BY_SRC}) AS rn FROM ledger), " + ", ".join(parts) + f" SELECT txn_id, {cols} FROM " + f"h{windows[0]} " + " ".join(f"JOIN h{w} USING (txn_id)" for w in windows[1:])


def _shown(c: str):
    """Rounded as its SQL rounds it."""
    return (fn.r96 if c.startswith(("Avg", "Bias", "avg")) else fn.r6)(F.col(c)).alias(c)


def _features(base: str):
    def run(s, d):
        cols = [f"{base}_{w}" for w in WINDOWS]
        out = temporal.temporal_features(events_ledger(s, d), WINDOWS, (base,))
        return out.select("txn_id", *(cols if _is_count(base) else [_shown(c) for c in cols]))
    return run


for _i, (_short, _base) in enumerate(zip(("avg", "total", "std", "bias", "number", "unique_destination", "unique_purpose", "unique_status"), BASE_FEATURES, strict=False), 1):
    query(f"w{_i}_{_short}", f"WITH {LEDGER_SQL} SELECT txn_id, {_window_sql(_base)} FROM ledger")(_features(_base))
query("w9_trading_entropy", _entropy_sql(WINDOWS))(_features("TradingEntropyT"))


@query("w9_entropy_by_domain", _entropy_sql((20,)))
def _(s, d):
    ledger = events_ledger(s, d)
    domain = sorted(r[0] for r in ledger.select("purpose").distinct().limit(51).collect())
    if len(domain) > 50:
        raise ValueError("the purpose set is too large for conditional sums")
    return temporal.entropy_by_domain(ledger, 20, domain).select("txn_id", *r6("TradingEntropyT_20"))


_EIGHT = BASE_FEATURES[:-1]


@query("temporal_all", f"WITH {LEDGER_SQL}, x AS ({_entropy_sql(WINDOWS)}) SELECT l.*, x.* EXCLUDE (txn_id) FROM (SELECT *, {', '.join(_window_sql(b) for b in _EIGHT)} FROM ledger) l JOIN x USING (txn_id)")
def temporal_all(s, d):
    out = temporal.temporal_features(events_ledger(s, d))
    done = {f"{b}_{w}": _shown(f"{b}_{w}") for b in BASE_FEATURES if not _is_count(b) for w in WINDOWS}
    return out.withColumns(done)


_ALL_WINDOWS = f"SELECT l.*, x.* EXCLUDE (txn_id) FROM (SELECT *, {', '.join(_window_sql(b) for b in _EIGHT)} FROM ledger) l JOIN x USING (txn_id)"


@query("u8_tensor", f"WITH {LEDGER_SQL}, x AS ({_entropy_sql(WINDOWS)}), w AS ({_ALL_WINDOWS}) SELECT txn_id, [" + ", ".join("[" + ", ".join(f"CAST({b}_{w} AS DOUBLE)" for w in WINDOWS) + "]" for b in BASE_FEATURES) + "] AS tensor, status_int AS label FROM w")
def _(s, d):
    return temporal.tensor(temporal_all(s, d)).drop("txn_time")


@query("p10_feature_names", "SELECT unnest([" + ", ".join(f"'{b}_{w}'" for b in BASE_FEATURES for w in WINDOWS) + "]) AS feature, split_part(feature, '_', 1) AS base, CAST(split_part(feature, '_', 2) AS INT) AS w")
def _(s, d):
    names = [c for c in temporal.temporal_features(events_ledger(s, d), purposes=["-"], hub=None).columns if any(c.startswith(b) for b in BASE_FEATURES)]
    return s.createDataFrame([(c,) for c in names], "feature string").select("feature", F.split_part("feature", F.lit("_"), F.lit(1)).alias("base"), F.split_part("feature", F.lit("_"), F.lit(2)).cast("int").alias("w"))


# --- as-of graph features
_NEW = "(row_number() OVER (PARTITION BY source_id, destination_id ORDER BY txn_time, txn_id) = 1)::BIGINT"
_DST = f"OVER (PARTITION BY destination_id ORDER BY txn_time, txn_id {PRIOR})"
_SRC = f"OVER ({BY_SRC} {PRIOR})"
_ASOF = {
    "c1_out_degree": ("out_degree_source", f"coalesce(sum(nf) {_SRC}, 0)::BIGINT"),
    "c2_in_degree": ("in_degree_destination", f"coalesce(sum(nf) {_DST}, 0)::BIGINT"),
    "c3_weighted_out_degree": ("weighted_out_degree_source", f"round(coalesce(sum(amount) {_SRC}, 0), 6) + 0.0"),
    "c4_weighted_in_degree": ("weighted_in_degree_destination", f"round(coalesce(sum(amount) {_DST}, 0), 6) + 0.0"),
    "c7_unique_neighbors": ("num_unique_neighbors_source", f"coalesce(sum(nf) {_SRC}, 0)::BIGINT"),
    "c8_avg_neighbor_amount": ("avg_neighbor_amt_source", f"round(round(coalesce(avg(amount) {_SRC}, 0), 9), 6) + 0.0"),
    "c9_ratio_new_neighbors": ("ratio_new_neighbors", "nf"),
    "c13_edge_recurrence": ("edge_recurrence", "1 - nf"),
}
_NF_SQL = f"{LEDGER_SQL}, n AS (SELECT *, {_NEW} AS nf FROM ledger)"


def _asof(col: str):
    def run(s, d):
        c = _shown(col) if "weighted" in col or "amt" in col else F.col(col)
        return asof.degree_features(events_ledger(s, d)).select("txn_id", c)
    return run


for _name, (_col, _expr) in _ASOF.items():
    query(_name, f"WITH {_NF_SQL} SELECT txn_id, {_expr} AS {_col} FROM n")(_asof(_col))

_PART_SQL = f"""ev AS (SELECT txn_id, txn_time, source_id AS node, CASE WHEN source_id = destination_id THEN 2 ELSE 1 END AS w, 's' AS role FROM ledger
 UNION ALL SELECT txn_id, txn_time, destination_id, 1, 'd' FROM ledger WHERE source_id <> destination_id),
 pr AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY node ORDER BY txn_time, txn_id {PRIOR}), 0)::BIGINT AS prior FROM ev),
 part AS (SELECT txn_id, max(prior) FILTER (role = 's') AS total_txns_source, coalesce(max(prior) FILTER (role = 'd'), max(prior) FILTER (role = 's')) AS total_txns_destination FROM pr GROUP BY 1)"""


@query("c5_total_txns_source", f"WITH {LEDGER_SQL}, {_PART_SQL} SELECT txn_id, total_txns_source FROM part")
def _(s, d):
    return asof.participation(events_ledger(s, d)).select("txn_id", "total_txns_source")


@query("c6_total_txns_destination", f"WITH {LEDGER_SQL}, {_PART_SQL} SELECT txn_id, total_txns_destination FROM part")
def _(s, d):
    return asof.participation(events_ledger(s, d)).select("txn_id", "total_txns_destination")


_TRI_SQL = """b AS (SELECT source_id u, destination_id v, min((txn_time, txn_id)) AS b FROM ledger WHERE source_id <> destination_id GROUP BY 1, 2),
 inc AS (SELECT u, v, b FROM b UNION ALL SELECT v, u, b FROM b),
 tri AS (SELECT x.u AS node, greatest(x.b, y.b, z.b) AS b, count(*) AS t FROM inc x JOIN inc y ON x.v = y.u AND y.v <> x.u JOIN inc z ON z.u = y.v AND z.v = x.u GROUP BY 1, 2),
 births AS (SELECT node, b, t, 0 AS d, 0 AS r FROM tri UNION ALL SELECT u, b, 0, 1, 0 FROM inc UNION ALL SELECT p.u, greatest(p.b, q.b), 0, 0, 1 FROM b p JOIN b q ON p.u = q.v AND p.v = q.u)"""
_COEF_SQL = "CASE WHEN t > 0 THEN t / (2.0 * (d * (d - 1) - 2 * r)) ELSE 0.0 END"
_C12_SQL = f"""{_TRI_SQL}, rows_ AS (SELECT node, b, 1 AS kind, t, d, r FROM births UNION ALL SELECT source_id, (txn_time, txn_id), 0, 0, 0, 0 FROM ledger),
 st AS (SELECT b, kind, sum(t) OVER w AS t, sum(d) OVER w AS d, sum(r) OVER w AS r FROM rows_ WINDOW w AS (PARTITION BY node ORDER BY b, kind {PRIOR}))"""


@query("c12_clustering", f"WITH {LEDGER_SQL}, {_C12_SQL} SELECT l.txn_id, round({_COEF_SQL}, 6) + 0.0 AS clustering_coeff_source FROM st JOIN ledger l ON st.b = (l.txn_time, l.txn_id) WHERE kind = 0")
def _(s, d):
    return asof.clustering_asof(events_ledger(s, d)).select("txn_id", *r6("clustering_coeff_source"))


@query("g4_clustering_final", f"WITH {NODE_SQL}, {_TRI_SQL}, tot AS (SELECT node, sum(t) t, sum(d) d, sum(r) r FROM births GROUP BY 1) SELECT id AS node, round(coalesce({_COEF_SQL}, 0), 6) + 0.0 AS clustering FROM nodes LEFT JOIN tot ON id = node")
def _(s, d):
    return asof.clustering_final(events_ledger(s, d)).select("node", *r6("clustering"))


# --- graph
@query("a12_edges", f"WITH {EDGE_SQL} SELECT source_id, destination_id, round(total_amount, 6) + 0.0 AS weight FROM e")
def _(s, d):
    return graph.edges(events_ledger(s, d)).select("source_id", "destination_id", fn.r6(F.col("total_amount")).alias("weight"))


@query("a13_edges_full", f"WITH {EDGE_SQL} SELECT source_id, destination_id, round(total_amount, 6) + 0.0 AS total_amount, n AS count, last_time FROM e")
def _(s, d):
    return graph.edges(events_ledger(s, d)).withColumn("total_amount", fn.r6(F.col("total_amount")))


_DEG_CTE = """deg AS (SELECT id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, coalesce(o.a, 0) - coalesce(i.a, 0) AS net_flow FROM nodes
 LEFT JOIN (SELECT destination_id id, count(*) n, sum(total_amount) a FROM e GROUP BY 1) i USING (id) LEFT JOIN (SELECT source_id id, count(*) n, sum(total_amount) a FROM e GROUP BY 1) o USING (id))"""
_DEG_SQL = f"{NODE_SQL}, {_DEG_CTE}"


@query("a14_degree", f"WITH {_DEG_SQL} SELECT id, in_degree, out_degree FROM deg")
def _(s, d):
    return graph.degrees(graph.edges(events_ledger(s, d))).select("id", "in_degree", "out_degree")


@query("a15_net_flow", f"WITH {_DEG_SQL} SELECT id, round(net_flow, 6) + 0.0 AS net_flow FROM deg")
def _(s, d):
    return graph.degrees(graph.edges(events_ledger(s, d))).select("id", *r6("net_flow"))


@query("a16_hist_degree", f"WITH {_DEG_SQL}, m AS (SELECT min(in_degree) mn, max(in_degree) mx FROM deg) SELECT CAST(least(49, floor((in_degree - mn) / (mx - mn)::DOUBLE * 50)) AS BIGINT) AS bin, count(*) AS n FROM deg, m GROUP BY 1")
def _(s, d):
    return graph.histogram(graph.degrees(graph.edges(events_ledger(s, d))), "in_degree")


def _hist_sql(measure: str, source: str) -> str:
    return f"SELECT '{measure}' AS measure, CAST(least(49, floor((x - lo) / (hi - lo) * 50)) AS BIGINT) AS bin, count(*) AS n FROM (SELECT {measure}::DOUBLE AS x FROM {source}) CROSS JOIN (SELECT min({measure}) - CASE WHEN min({measure}) = max({measure}) THEN 0.5 ELSE 0 END AS lo, max({measure}) + CASE WHEN min({measure}) = max({measure}) THEN 0.5::DOUBLE ELSE 0 END AS hi FROM {source}) GROUP BY 2"


@query("a17_edge_range", f"WITH {EDGE_SQL} SELECT round(coalesce(max(total_amount), 1), 6) + 0.0 AS mx, round(min(total_amount), 6) + 0.0 AS mn FROM e")
def _(s, d):
    return graph.edges(events_ledger(s, d)).agg(fn.r6(F.coalesce(F.max("total_amount"), F.lit(1.0))).alias("mx"), fn.r6(F.min("total_amount")).alias("mn"))


@query("a22_shapes", f"WITH {LEDGER_SQL} SELECT count(*) AS txns, count(DISTINCT source_id) AS sources, count(DISTINCT destination_id) AS destinations FROM ledger")
def _(s, d):
    return events_ledger(s, d).agg(F.count(F.lit(1)).alias("txns"), F.countDistinct("source_id").alias("sources"), F.countDistinct("destination_id").alias("destinations"))


_PR_BASE = f"{NODE_SQL}, ow AS (SELECT source_id, sum(total_amount) w FROM e GROUP BY 1), sh AS (SELECT source_id s, destination_id d, total_amount / w AS p FROM e JOIN ow USING (source_id)), nn AS (SELECT count(*)::DOUBLE n FROM nodes), p0 AS MATERIALIZED (SELECT id, 1 / n AS r FROM nodes, nn)"
_PR_STEPS = ", ".join(f"p{k} AS MATERIALIZED (SELECT nodes.id, 0.15 / n + 0.85 * ((SELECT coalesce(sum(r), 0) FROM p{k - 1} WHERE id NOT IN (SELECT source_id FROM ow)) / n + coalesce(f.x, 0)) AS r FROM nodes CROSS JOIN nn LEFT JOIN (SELECT d AS id, sum(r * p) x FROM sh JOIN p{k - 1} ON s = id GROUP BY 1) f ON f.id = nodes.id)" for k in range(1, 11))
PR_SQL = f"{_PR_BASE}, {_PR_STEPS}"


def _ranks(s, d):
    return graph.pagerank(graph.edges(events_ledger(s, d)), iterations=10)


@query("g1_pagerank", f"WITH {PR_SQL} SELECT id, round(r, 9) + 0.0 AS pagerank FROM p10")
def _(s, d):
    return _ranks(s, d).select("id", (F.round("pagerank", 9) + F.lit(0.0)).alias("pagerank"))


@query("c10_c11_pagerank_features", f"WITH {PR_SQL} SELECT txn_id, round(coalesce(a.r, 0), 9) + 0.0 AS pagerank_source, round(coalesce(b.r, 0), 9) + 0.0 AS pagerank_destination FROM ledger LEFT JOIN p10 a ON source_id = a.id LEFT JOIN p10 b ON destination_id = b.id")
def _(s, d):
    r = _ranks(s, d)
    a, b = r.select(F.col("id").alias("source_id"), F.col("pagerank").alias("a")), r.select(F.col("id").alias("destination_id"), F.col("pagerank").alias("b"))
    rounded = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 9) + F.lit(0.0)
    return events_ledger(s, d).join(a, "source_id", "left").join(b, "destination_id", "left").select("txn_id", rounded("a").alias("pagerank_source"), rounded("b").alias("pagerank_destination"))


@query("j4_node_table", f"WITH {PR_SQL}, {_DEG_CTE} SELECT id, round(r, 9) + 0.0 AS pagerank, in_degree, out_degree, round(net_flow, 6) + 0.0 AS net_flow FROM deg JOIN p10 USING (id)")
def _(s, d):
    e = graph.edges(events_ledger(s, d))
    return graph.node_table(e, graph.pagerank(e, iterations=10)).select("id", (F.round("pagerank", 9) + F.lit(0.0)).alias("pagerank"), "in_degree", "out_degree", *r6("net_flow"))


_COMPONENTS = "reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT reach.a, e.destination_id FROM reach JOIN e ON reach.b = e.source_id), comp AS (SELECT x.a AS id, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1)"
_NODE_TABLE = f"{PR_SQL}, {_DEG_CTE}, nt AS (SELECT id, round(r, 9) AS pagerank, in_degree, out_degree, round(net_flow, 6) AS net_flow FROM deg JOIN p10 USING (id))"


@query("a16_histograms", f"WITH RECURSIVE {_NODE_TABLE}, {_COMPONENTS}, sz AS (SELECT count(*) AS component_size FROM comp GROUP BY component) " + " UNION ALL ".join([*[_hist_sql(m, "nt") for m in ("in_degree", "out_degree", "pagerank", "net_flow")], _hist_sql("component_size", "sz")]))
def _(s, d):
    e = graph.edges(events_ledger(s, d))
    return graph.summary_histograms(e, graph.pagerank(e, iterations=10))


_CLOSE = ", ".join(f"c{k} AS (SELECT {k} AS k, sum(abs(a.r - b.r)) AS change FROM p{k} a JOIN p{k - 1} b USING (id))" for k in range(1, 11))


@query("g1_pagerank_converged", f"WITH {PR_SQL}, {_CLOSE}, stop AS (SELECT min(k) AS k FROM ({' UNION ALL '.join(f'FROM c{k}' for k in range(1, 11))}), nn WHERE change < n * 1e-6) SELECT id, round(r, 9) + 0.0 AS pagerank FROM ({' UNION ALL '.join(f'SELECT {k} AS k, * FROM p{k}' for k in range(1, 11))}) JOIN stop USING (k)")
def _(s, d):
    return graph.pagerank(graph.edges(events_ledger(s, d))).select("id", (F.round("pagerank", 9) + F.lit(0.0)).alias("pagerank"))


@query("viz_nodes", f"WITH {_NODE_TABLE}, s AS (SELECT min(pagerank) AS lo, max(pagerank) AS hi FROM nt) SELECT id, pagerank + 0.0 AS pagerank, round((pagerank - lo) / (hi - lo), 6) + 0.0 AS value, printf('rgba(255, %d, 0, 0.8)', greatest(0, trunc(255 * (1 - 10 * pagerank))::INT)) AS color, printf('Node: %d<br>PageRank: %.4f<br>Degree: %d/%d', id, pagerank, in_degree, out_degree) AS title FROM nt, s")
def _(s, d):
    e = graph.edges(events_ledger(s, d))
    n = graph.node_table(e, graph.pagerank(e, iterations=10).withColumn("pagerank", F.round("pagerank", 9) + F.lit(0.0)))
    return graph.visual_attributes(e, n)[1].select("id", "pagerank", *r6("value"), "color", "title")


@query("viz_edge_titles", f"WITH {EDGE_SQL} SELECT source_id, destination_id, printf('Amount: %.2f<br>Count: %d', round(total_amount, 6), n) AS title FROM e")
def _(s, d):
    e = graph.edges(events_ledger(s, d)).withColumn("total_amount", fn.r6(F.col("total_amount")))
    return graph.visual_attributes(e, graph.degrees(e).withColumn("pagerank", F.lit(0.0)))[0].select("source_id", "destination_id", "title")


_CLOSURE = f"WITH RECURSIVE {NODE_SQL}, reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT reach.a, e.destination_id FROM reach JOIN e ON reach.b = e.source_id), comp AS (SELECT x.a AS id, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1)"


@query("g5_scc", f"{_CLOSURE} SELECT id, component FROM comp")
def _(s, d):
    return graph.scc(graph.edges(events_ledger(s, d)))


@query("a21_component_sizes", f"{_CLOSURE} SELECT component, count(*) AS size FROM comp GROUP BY 1")
def _(s, d):
    return graph.component_sizes(graph.scc(graph.edges(events_ledger(s, d))))


@query("g6_top_scc", f"{_CLOSURE}, top AS (SELECT component, count(*) AS size FROM comp GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4) SELECT source_id, destination_id, round(total_amount, 6) + 0.0 AS total_amount, top.component, size FROM e JOIN comp a ON source_id = a.id JOIN comp b ON destination_id = b.id AND a.component = b.component JOIN top ON top.component = a.component")
def _(s, d):
    e = graph.edges(events_ledger(s, d))
    return graph.top_components(e, graph.scc(e)).select("source_id", "destination_id", *r6("total_amount"), "component", "size")


@query("g7_top_pagerank_subgraph", f"WITH {PR_SQL}, keep AS (SELECT id FROM p10 ORDER BY round(r, 12) DESC, id LIMIT 200) SELECT source_id, destination_id, round(total_amount, 6) + 0.0 AS total_amount FROM e WHERE source_id IN (FROM keep) AND destination_id IN (FROM keep) ORDER BY e.total_amount DESC, source_id, destination_id LIMIT 500")
def _(s, d):
    e = graph.edges(events_ledger(s, d))
    ranks = graph.pagerank(e, iterations=10).withColumn("pagerank", F.round("pagerank", 12))
    return graph.top_subgraph(e, ranks).select("source_id", "destination_id", *r6("total_amount"))


@query("g8_sampled_subgraph", f"WITH {_DEG_SQL}, top AS (SELECT id FROM deg ORDER BY in_degree + out_degree DESC, id LIMIT 30), rest AS (SELECT id FROM deg WHERE id NOT IN (FROM top) ORDER BY {draw_sql(42, 'id')}, id LIMIT 30), keep AS (FROM top UNION FROM rest) SELECT source_id, destination_id, round(total_amount, 6) + 0.0 AS total_amount, n AS count FROM e WHERE source_id IN (FROM keep) AND destination_id IN (FROM keep)")
def _(s, d):
    e = graph.edges(events_ledger(s, d))
    return graph.induced(e, graph.sampled_nodes(e, 60, 42)).select("source_id", "destination_id", *r6("total_amount"), "count")


# Distances in whole cents, so that equal paths are equal; min-plus squaring, then path counts by number of steps.
_SQUARES, _STEPS = 6, 40
_BETWEENNESS = ", ".join([
    "c AS (SELECT source_id AS u, destination_id AS v, round(total_amount * 100)::BIGINT AS w FROM e WHERE source_id <> destination_id)",
    "d0 AS MATERIALIZED (SELECT id AS s, id AS t, 0::BIGINT AS d FROM nodes UNION ALL FROM c)",
    *[f"d{k} AS MATERIALIZED (SELECT a.s, b.t, min(a.d + b.d) AS d FROM d{k - 1} a JOIN d{k - 1} b ON a.t = b.s GROUP BY 1, 2)" for k in range(1, _SQUARES + 1)],
    f"g AS MATERIALIZED (SELECT x.s, c.u, c.v FROM d{_SQUARES} x JOIN c ON c.u = x.t JOIN d{_SQUARES} y ON y.s = x.s AND y.t = c.v WHERE x.d + c.w = y.d)",
    "h0 AS (SELECT id AS s, id AS t, 1::DOUBLE AS n FROM nodes)",
    *[f"h{k} AS MATERIALIZED (SELECT g.s, g.v AS t, sum(h.n) AS n FROM h{k - 1} h JOIN g ON g.s = h.s AND g.u = h.t GROUP BY 1, 2)" for k in range(1, _STEPS + 1)],
    f"ways AS MATERIALIZED (SELECT s, t, sum(n) AS n FROM ({' UNION ALL '.join(f'FROM h{k}' for k in range(_STEPS + 1))}) GROUP BY 1, 2)",
    f"far AS MATERIALIZED (SELECT s, t, d, n FROM d{_SQUARES} JOIN ways USING (s, t))",
    "through AS (SELECT a.t AS id, sum(a.n * b.n / y.n) AS x FROM far a JOIN far b ON a.t = b.s JOIN far y ON y.s = a.s AND y.t = b.t AND y.d = a.d + b.d WHERE a.s <> a.t AND b.s <> b.t AND a.s <> b.t GROUP BY 1)",
])


@query("g3_betweenness", f"WITH {NODE_SQL}, {_BETWEENNESS} SELECT id, round(coalesce(x, 0) / ((SELECT count(*) FROM nodes) - 1) / ((SELECT count(*) FROM nodes) - 2), 9) + 0.0 AS betweenness FROM nodes LEFT JOIN through USING (id)")
def _(s, d):
    e = graph.edges(events_ledger(s, d)).withColumn("total_amount", F.round(F.col("total_amount") * 100))
    return graph.betweenness(e).select("id", (F.round("betweenness", 9) + F.lit(0.0)).alias("betweenness"))


@query("viz_edge_widths", f"WITH {EDGE_SQL}, m AS (SELECT max(total_amount) mx FROM e) SELECT source_id, destination_id, round(1 + 5 * ln(1 + total_amount) / ln(1 + mx), 6) + 0.0 AS width, round(0.5 + 2 * ln(1 + total_amount) / ln(1 + mx), 6) + 0.0 AS thin_width FROM e, m")
def _(s, d):
    e = graph.edges(events_ledger(s, d))
    return graph.visual_attributes(e, graph.degrees(e).withColumn("pagerank", F.lit(0.0)))[0].select("source_id", "destination_id", *r6("width", "thin_width"))


@query("j8_induced", f"WITH {_DEG_SQL}, k AS (SELECT id FROM deg WHERE round(net_flow, 6) > 0) SELECT source_id, destination_id, n AS count FROM e WHERE source_id IN (FROM k) AND destination_id IN (FROM k)")
def _(s, d):
    e = graph.edges(events_ledger(s, d))
    return graph.induced(e, graph.degrees(e).where(F.round("net_flow", 6) > 0)).select("source_id", "destination_id", "count")


@query("j9_anti", f"WITH {_DEG_SQL} SELECT id FROM deg WHERE id NOT IN (SELECT id FROM deg ORDER BY in_degree + out_degree DESC, id LIMIT 20)")
def _(s, d):
    deg = graph.degrees(graph.edges(events_ledger(s, d)))
    return deg.join(deg.orderBy(F.desc(F.col("in_degree") + F.col("out_degree")), "id").limit(20), "id", "left_anti").select("id")


@query("j6_edge_exists", f"WITH {LEDGER_SQL} SELECT a.txn_id, EXISTS (SELECT 1 FROM ledger b WHERE b.source_id = a.source_id AND b.destination_id = a.destination_id AND (b.txn_time, b.txn_id) < (a.txn_time, a.txn_id)) AS seen FROM ledger a")
def _(s, d):
    return asof.first_contact(events_ledger(s, d)).select("txn_id", (F.col("new_edge") == 0).alias("seen"))


@query("u2_union", f"WITH {EDGE_SQL} (SELECT source_id AS id, 'source' AS role FROM e) UNION (SELECT destination_id, 'destination' FROM e)")
def _(s, d):
    e = graph.edges(events_ledger(s, d))
    return e.select(F.col("source_id").alias("id"), F.lit("source").alias("role")).union(e.select("destination_id", F.lit("destination"))).distinct()


@query("u4_nodes", f"WITH {NODE_SQL} SELECT id FROM nodes")
def _(s, d):
    return graph.nodes(graph.edges(events_ledger(s, d)))


@query("u6_unpivot", f"WITH {LEDGER_SQL} SELECT txn_id, source_id AS node, CASE WHEN source_id = destination_id THEN 2 ELSE 1 END::BIGINT AS weight FROM ledger UNION ALL SELECT txn_id, destination_id, 1 FROM ledger WHERE source_id <> destination_id")
def _(s, d):
    return asof.node_events(events_ledger(s, d)).select("txn_id", "node", "weight")


# --- profile
_HEAT_SQL = f"h AS (SELECT CAST(extract(hour FROM t) AS INT) AS hour, CAST(extract(dow FROM t) AS INT) AS dow, count(*) AS volume FROM (SELECT created_on + INTERVAL '5 hours 45 minutes' AS t FROM gate) GROUP BY 1, 2)"


@query("a1_heatmap_tz", f"WITH {GATE_SQL}, {_HEAT_SQL} SELECT * FROM h")
def _(s, d):
    return profile.heatmap(events_gateway(s, d), TZ)


@query("a2_heatmap_dense", f"WITH {GATE_SQL}, {_HEAT_SQL} SELECT CAST(a.range AS INT) AS hour, CAST(b.range AS INT) AS dow, coalesce(volume, 0) AS volume FROM range(24) a, range(7) b LEFT JOIN h ON h.hour = a.range AND h.dow = b.range")
def _(s, d):
    return profile.dense_heatmap(profile.heatmap(events_gateway(s, d), TZ))


@query("a3_categorical_profile", f"WITH {GATE_SQL}, c AS (SELECT purpose AS value, count(*) AS volume FROM gate WHERE purpose IS NOT NULL GROUP BY 1) SELECT 'purpose' AS \"column\", value, round(volume / sum(volume) OVER (), 6) + 0.0 AS prob, volume, round(coalesce(stddev_samp(volume) OVER () / volume, 0), 6) + 0.0 AS relative_error FROM c ORDER BY volume DESC, value LIMIT 10")
def _(s, d):
    return profile.categorical(events_gateway(s, d), "purpose").select("column", "value", *r6("prob"), "volume", *r6("relative_error"))


@query("a4_p95", f"WITH {GATE_SQL} SELECT round(quantile_cont(amount, 0.95), 6) + 0.0 AS p95 FROM gate WHERE created_on >= TIMESTAMP '{START}' AND amount > 0")
def _(s, d):
    return profile.percentile(temporal.recent(events_gateway(s, d), "created_on", START)).select(*r6("p95"))


_TAIL_SQL = f"{GATE_SQL}, g AS (SELECT * FROM gate WHERE created_on >= TIMESTAMP '{START}' AND amount > 0), p AS (SELECT quantile_cont(amount, 0.95) AS p95 FROM g), ts_ AS (SELECT count(*) n, sum(ln(amount / p95)) sum_ln, min(amount) mn, max(amount) mx, avg(amount) mean, max(p95) th FROM g, p WHERE amount >= p95)"


def _tail(s, d):
    return profile.tail(temporal.recent(events_gateway(s, d), "created_on", START))


@query("j2_theta_threshold", f"WITH {_TAIL_SQL} SELECT created_on, amount, source_id FROM g, p WHERE amount >= p95")
def _(s, d):
    return _tail(s, d).select("created_on", "amount", "source_id")


@query("a5_tail_count", f"WITH {_TAIL_SQL} SELECT n FROM ts_")
def _(s, d):
    return profile.tail_stats(_tail(s, d)).select("n")


@query("a6_tail_stats", f"WITH {_TAIL_SQL} SELECT n, round(sum_ln, 6) + 0.0 AS sum_ln, mn AS min, mx AS max, round(mean, 6) + 0.0 AS mean, round(th, 6) + 0.0 AS threshold FROM ts_")
def _(s, d):
    return profile.tail_stats(_tail(s, d)).select("n", *r6("sum_ln"), "min", "max", *r6("mean", "threshold"))


@query("a7_pareto_fit", f"WITH {_TAIL_SQL} SELECT round(1 + n / sum_ln, 6) AS pareto_alpha, round((1 + n / sum_ln) * (1 - 1.96 / sqrt(n)), 6) AS alpha_ci_lower, round((1 + n / sum_ln) * (1 + 1.96 / sqrt(n)), 6) AS alpha_ci_upper, round(n / sum_ln, 6) AS survival_alpha FROM ts_")
def _(s, d):
    return profile.pareto_fit(profile.tail_stats(_tail(s, d))).select(*r6("pareto_alpha", "alpha_ci_lower", "alpha_ci_upper", "survival_alpha"))


@query("j3_scalar_subquery", f"WITH {_TAIL_SQL} SELECT round((SELECT p95 FROM p), 6) AS p95, (SELECT count(*) FROM g) AS n, (SELECT n FROM ts_) AS tail_n")
def _(s, d):
    g = temporal.recent(events_gateway(s, d), "created_on", START)
    return profile.percentile(g).join(F.broadcast(g.agg(F.count(F.lit(1)).alias("n")))).join(F.broadcast(profile.tail_stats(profile.tail(g)).select(F.col("n").alias("tail_n")))).select(*r6("p95"), "n", "tail_n")


_DEGREE_SQL = f"{GATE_SQL}, u AS (SELECT source_id, count(*) c FROM gate GROUP BY 1)"


@query("a8_degree_stats", f"WITH {_DEGREE_SQL} SELECT count(*) AS users, sum(c)::BIGINT AS transactions, round(sum(ln(c)), 6) AS sum_ln, quantile_cont(c, 0.5)::DOUBLE AS median FROM u")
def _(s, d):
    return profile.degree_stats(events_gateway(s, d)).select("users", "transactions", *r6("sum_ln"), "median")


@query("a9_degree_alpha", f"WITH {_DEGREE_SQL} SELECT count(*) AS users, round(1 + count(*) / sum(ln(c)), 6) AS user_degree_pareto_alpha FROM u")
def _(s, d):
    return profile.degree_alpha(events_gateway(s, d)).select("users", *r6("user_degree_pareto_alpha"))


@query("a10_hll_users", f"WITH {_DEGREE_SQL} SELECT count(*) AS users, round(avg(c), 6) + 0.0 AS avg_degree, round(stddev_samp(c), 6) + 0.0 AS sd_degree, round(1 + 1 / ln(avg(c)), 6) AS user_degree_pareto_alpha, true AS sketch_within_3_percent FROM u")
def _(s, d):
    near = (F.abs(F.col("approx_users") - F.col("users")) <= 0.03 * F.col("users")).alias("sketch_within_3_percent")
    return profile.degree_sketch(events_gateway(s, d)).select("users", *r6("avg_degree", "sd_degree", "user_degree_pareto_alpha"), near)


@query("src8_topology_methods", f"WITH {_DEGREE_SQL} SELECT 'hyperloglog' AS estimation_method, round(1 + 1 / ln(avg(c)), 6) AS user_degree_pareto_alpha FROM u UNION ALL SELECT 'sampling', round(1 + count(*) / sum(ln(c)), 6) FROM u")
def _(s, d):
    g = events_gateway(s, d)
    return profile.topology(g, "hll").unionByName(profile.topology(g)).select("estimation_method", *r6("user_degree_pareto_alpha"))


@query("a11_count", f"WITH {GATE_SQL} SELECT count(*) AS n FROM gate WHERE created_on >= TIMESTAMP '{START}' AND amount > 0")
def _(s, d):
    return temporal.recent(events_gateway(s, d), "created_on", START).agg(F.count(F.lit(1)).alias("n"))


_REPORT = ProfileConfig(window_start=START, extracted_at="2024-01-30T00:00:00Z")


def _category_sql(column: str, shown: str) -> str:
    fields = " UNION ALL ".join(f"SELECT '{column}/' || k || '/{f}' AS field, {v} AS value FROM {column}_" for f, v in (("prob", "round(prob, 6)"), ("volume", "volume::DOUBLE"), ("relative_error", "round(relative_error, 4)")))
    return f"""{column}_ AS (SELECT {shown} AS k, volume, volume / sum(volume) OVER () AS prob, coalesce(stddev_samp(volume) OVER () / volume, 0) AS relative_error FROM (SELECT {column}, count(*) AS volume FROM gate WHERE created_on >= TIMESTAMP '{START}' AND {column} IS NOT NULL GROUP BY 1) ORDER BY volume DESC, k LIMIT 10),
    {column}_r AS ({fields} UNION ALL SELECT '{column}/_metadata/sampling_ratio', 1.0 UNION ALL SELECT '{column}/_metadata/total_sample_size', sum(volume)::DOUBLE FROM {column}_)"""


_REPORT_SQL = f"""WITH {_TAIL_SQL}, h AS (SELECT CAST(extract(hour FROM t) AS INT) AS hour, CAST(extract(dow FROM t) AS INT) AS dow, count(*) AS volume FROM (SELECT created_on + INTERVAL '5 hours 45 minutes' AS t FROM g) GROUP BY 1, 2),
    u AS (SELECT source_id, count(*) c FROM g GROUP BY 1), {_category_sql('is_obsolete', "CASE WHEN is_obsolete THEN 'True' ELSE 'False' END")}, {_category_sql('purpose', 'purpose')}
    SELECT 'temporal_heatmap' AS section, a.range || '/' || b.range AS field, coalesce(volume, 0)::DOUBLE AS value, NULL::VARCHAR AS text FROM range(24) a, range(7) b LEFT JOIN h ON h.hour = a.range AND h.dow = b.range
    UNION ALL SELECT 'categorical_weights', field, value + 0.0, NULL FROM (FROM is_obsolete_r UNION ALL FROM purpose_r)
    UNION ALL SELECT 'monetary_distribution', unnest(['pareto_alpha', 'alpha_ci_lower', 'alpha_ci_upper', 'tail_threshold', 'tail_count_approx', 'reservoir_samples', 'tail_statistics.min', 'tail_statistics.max', 'tail_statistics.mean']),
      round(unnest([1 + n / sum_ln, (1 + n / sum_ln) * (1 - 1.96 / sqrt(n)), (1 + n / sum_ln) * (1 + 1.96 / sqrt(n)), th, n, n, mn, mx, mean]), 6) + 0.0, NULL FROM ts_
    UNION ALL SELECT 'graph_topology', 'user_degree_pareto_alpha', round(1 + count(*) / sum(ln(c)), 6), NULL FROM u
    UNION ALL FROM (VALUES ('metadata', 'extraction_timestamp', NULL::DOUBLE, '2024-01-30T00:00:00Z'), ('metadata', 'window_days', 14.0, NULL), ('metadata', 'sampling_used', 0.0, NULL), ('metadata', 'sample_ratio', 1.0, NULL), ('temporal_heatmap', 'sampling_error', 0.0, NULL), ('temporal_heatmap', 'confidence_level', 1.0, NULL),
      ('graph_topology', 'estimation_method', NULL, 'sampling'), ('graph_topology', 'confidence', NULL, 'exact'), ('graph_topology', 'sampling_error_margin', 0.0, NULL))"""


@query("profile_report", _REPORT_SQL)
def _(s, d):
    return profile.flat_report(profile.profile_report(events_gateway(s, d), _REPORT))


@query("src4_profile_weights", f"WITH {GATE_SQL}, {_category_sql('is_obsolete', 'is_obsolete::VARCHAR')}, {_category_sql('purpose', 'purpose')} SELECT 'is_obsolete' AS category, CASE k WHEN 'true' THEN 'True' ELSE 'False' END AS value, greatest(round(prob, 6), 0.0001) + 0.0 AS weight FROM is_obsolete_ UNION ALL SELECT 'purpose', k, greatest(round(prob, 6), 0.0001) + 0.0 FROM purpose_ UNION ALL SELECT 'absent', 'unknown', 1.0")
def _(s, d):
    path = scratch(s, "profile")
    sinks.write_report(profile.profile_report(events_gateway(s, d), _REPORT), path)
    weights = read_profile(s, path).select(F.explode(F.create_map(*[x for c in ("is_obsolete", "purpose", "absent") for x in (F.lit(c), fn.category_weights(F.col("categorical_weights")[f"gateway_transaction.{c}"]))])).alias("category", "w"))
    return weights.select("category", F.explode("w").alias("value", "weight"))


@query("s4_heatmap_ordered", f"WITH {GATE_SQL}, {_HEAT_SQL} SELECT row_number() OVER (ORDER BY hour, dow) AS place, * FROM h")
def _(s, d):
    h = profile.heatmap(events_gateway(s, d), TZ).orderBy("hour", "dow")  # at most 168 rows
    return h.agg(F.collect_list(F.struct("hour", "dow", "volume")).alias("rows")).select(F.posexplode("rows").alias("p", "r")).select((F.col("p") + 1).cast("long").alias("place"), "r.*")


@query("s6_limit_before_agg", f"WITH {LEDGER_SQL}, c AS (SELECT purpose AS value, count(*) AS volume FROM (FROM ledger ORDER BY txn_time, txn_id LIMIT 5000) GROUP BY 1) SELECT 'purpose' AS \"column\", value, round(volume / sum(volume) OVER (), 6) + 0.0 AS prob, volume, round(coalesce(stddev_samp(volume) OVER () / volume, 0), 6) + 0.0 AS relative_error FROM c ORDER BY volume DESC, value LIMIT 10")
def _(s, d):
    return profile.categorical(events_ledger(s, d).orderBy("txn_time", "txn_id"), "purpose", min_sample=5000).select("column", "value", *r6("prob"), "volume", *r6("relative_error"))


@query("s10_preview", f"WITH {LEDGER_SQL} FROM ledger ORDER BY txn_time, txn_id LIMIT 10")
def _(s, d):
    return events_ledger(s, d).orderBy("txn_time", "txn_id").limit(10)


# --- sorts, samples
@query("s5_topk", f"WITH {GATE_SQL} SELECT purpose AS value, count(*) AS volume FROM gate GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def _(s, d):
    return profile.categorical(events_gateway(s, d), "purpose", 3).select("value", "volume")


@query("s8_top_edges", f"WITH {EDGE_SQL} SELECT source_id, destination_id, round(total_amount, 6) + 0.0 AS total_amount FROM e ORDER BY e.total_amount DESC, source_id, destination_id LIMIT 20")
def _(s, d):
    return graph.edges(events_ledger(s, d)).orderBy(F.desc("total_amount"), "source_id", "destination_id").limit(20).select("source_id", "destination_id", *r6("total_amount"))


@query("s1_sorted_ledger", f"WITH {LEDGER_SQL} SELECT txn_id, txn_time FROM ledger ORDER BY txn_time, txn_id")
def _(s, d):
    return events_ledger(s, d).orderBy("txn_time", "txn_id").select("txn_id", "txn_time")


@query("s7_random_topk", f"WITH {LEDGER_SQL} FROM ledger ORDER BY {draw_sql(42, 'txn_id')}, txn_id LIMIT 100")
def _(s, d):
    return profile.reservoir(events_ledger(s, d), 100, 42, "txn_id")


# --- scalar functions
@query("f1_local_time", "SELECT event_id, CAST(extract(hour FROM ts + INTERVAL '5 hours 45 minutes') AS INT) AS hour, CAST(extract(dow FROM ts + INTERVAL '5 hours 45 minutes') AS INT) AS dow FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", fn.local_hour(F.col("ts"), TZ).alias("hour"), fn.local_dow(F.col("ts"), TZ).alias("dow"))


@query("f10_cents", "SELECT event_id, round(value / 3 * 100) / 100 AS amount FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", fn.cents(F.col("value") / 3).alias("amount"))


@query("f12_formats", "SELECT printf('u_%06d', user_id) AS user_id, printf('TXN_%010d', event_id) AS txn_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS rfc3339 FROM events")
def _(s, d):
    return table(s, d, "events").select(F.format_string("u_%06d", "user_id").alias("user_id"), F.format_string("TXN_%010d", "event_id").alias("txn_id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssxxx").alias("rfc3339"))


# --- synthesis
@query("r1_pareto_amounts", f"SELECT event_id AS txn_id, round(100.0 * pow(1 - {draw_sql(42, 'event_id')}, -1 / 2.5::DOUBLE) * 100) / 100 AS amount FROM events")
def _(s, d):
    return synth.sample_amounts(events_ledger(s, d).select("txn_id"), 100.0, 2.5, 42, "txn_id")


@query("r2_pareto_degrees", f"SELECT CAST(range AS BIGINT) AS user_index, printf('u_%06d', range) AS user_id, CAST(range // 100 AS BIGINT) AS cluster_id, CAST(least(round(pow(1 / (1 - {draw_sql(42, 'range')}), {1 / 1.8!r}::DOUBLE)), 9000) AS BIGINT) AS num_txns FROM range(1000)")
def _(s, d):
    return synth.pareto_degrees(users(s, 1000), 1.8, 90_000, 42)


def _choice_sql(weights: dict[str, float], u: str) -> str:
    total, cases = 0.0, []
    for v in sorted(weights):
        total += weights[v]
        cases.append((v, total))
    return "CASE " + " ".join(f"WHEN {u} * {total!r}::DOUBLE < {c!r}::DOUBLE THEN '{v}'" for v, c in cases[:-1]) + f" ELSE '{cases[-1][0]}' END"


_PURPOSES = {"bill": 0.2, "p2p": 0.7, "topup": 0.1}


@query("r3_weighted_choice", f"SELECT event_id AS txn_id, {_choice_sql(_PURPOSES, draw_sql(42, 'event_id'))} AS purpose FROM events")
def _(s, d):
    return synth.choose(events_ledger(s, d).select("txn_id"), "purpose", _PURPOSES, 42, "txn_id")


@query("r6_tick_intensity", f"WITH {GATE_SQL}, h AS (SELECT CAST(extract(hour FROM created_on) AS INT) AS hour, CAST(extract(dow FROM created_on) AS INT) AS dow, count(*) AS volume FROM gate GROUP BY 1, 2), t AS (SELECT CAST(range AS BIGINT) AS tick, TIMESTAMP '2024-01-01' + to_minutes(CAST(range AS INT)) AS m FROM range(10080)) SELECT tick, round(volume / (SELECT sum(volume) FROM h) * (3000 / 1440.0 * 168), 6) AS lam FROM t JOIN h ON h.hour = extract(hour FROM m) AND h.dow = extract(dow FROM m)")
def _(s, d):
    h = profile.heatmap(events_gateway(s, d), "UTC")
    return synth.tick_intensity(h, SynthConfig(num_users=1000, num_days=7), s).select("tick", *r6("lam"))


_SYNTH = SynthConfig(num_users=1000, num_days=7)
_STATUS, _KINDS = {"False": 0.9, "True": 0.1}, {"p2p": 0.7, "bill": 0.3}
_RATE = _SYNTH.num_users * 3 * _SYNTH.num_days / (_SYNTH.num_days * 1440) * 168


def _seeded(k: int) -> str:
    return draw_sql(_SYNTH.seed + k, "tick", "seq")


@query("synth_ledger", f"""WITH {GATE_SQL}, h AS (SELECT CAST(extract(hour FROM created_on) AS INT) AS hour, CAST(extract(dow FROM created_on) AS INT) AS dow, count(*) AS volume FROM gate GROUP BY 1, 2),
    t AS (SELECT CAST(range AS BIGINT) AS tick, TIMESTAMP '2024-01-01' + to_minutes(CAST(range AS INT)) AS txn_time FROM range({_SYNTH.num_days * 1440})),
    l AS (SELECT tick, txn_time, volume / (SELECT sum(volume) FROM h)::DOUBLE * {_RATE!r}::DOUBLE AS lam FROM t JOIN h ON h.hour = extract(hour FROM txn_time) AND h.dow = extract(dow FROM txn_time)),
    n AS (SELECT tick, txn_time, floor(lam)::BIGINT + ({draw_sql(_SYNTH.seed, 'tick')} < lam - floor(lam))::BIGINT AS n FROM l),
    r AS (SELECT tick, txn_time, unnest(range(1, n + 1)) AS seq FROM n),
    a AS (SELECT *, floor({_seeded(1)} * 1000)::BIGINT AS src, row_number() OVER (ORDER BY tick, seq) - 1 AS place FROM r),
    b AS (SELECT *, CASE WHEN {_seeded(4)} < {_SYNTH.in_cluster} THEN (src // 100 * 100 + floor({_seeded(5)} * 100)::BIGINT) % 1000 ELSE floor({_seeded(6)} * 1000)::BIGINT END AS dst FROM a)
    SELECT printf('TXN_%010d', place) AS txn_id, txn_time, round(100.0 * pow(1 - {_seeded(2)}, -1 / 2.5::DOUBLE) * 100) / 100 AS amount, printf('u_%06d', src) AS source_id,
      printf('u_%06d', CASE WHEN dst = src THEN (dst + 1) % 1000 ELSE dst END) AS destination_id, {_choice_sql(_STATUS, _seeded(7))} = 'True' AS status, {_choice_sql(_KINDS, _seeded(8))} AS purpose FROM b""")
def _(s, d):
    h = profile.dense_heatmap(profile.heatmap(events_gateway(s, d), "UTC"))
    out = synth.synthesize(s, h, _SYNTH, minimum=100.0, alpha=2.5, status=_STATUS, purpose=_KINDS, tz="UTC")
    return out.withColumn("txn_time", F.col("txn_time").cast("timestamp_ntz"))


# --- compositions
_ASOF_SQL = ", ".join(f"{e} AS {c}" for c, e in _ASOF.values())
_ALL_SQL = f"{_NF_SQL}, {_PART_SQL}, {_C12_SQL}, cl AS (SELECT l.txn_id, round({_COEF_SQL}, 6) + 0.0 AS clustering_coeff_source FROM st JOIN ledger l ON st.b = (l.txn_time, l.txn_id) WHERE kind = 0), deg_ AS (SELECT txn_id, {_ASOF_SQL} FROM n)"


@query("asof_all", f"WITH {_ALL_SQL} SELECT * FROM deg_ JOIN part USING (txn_id) JOIN cl USING (txn_id)")
def _(s, d):
    ledger = events_ledger(s, d)
    base = asof.degree_features(ledger).select("txn_id", *[F.col(c) if "weighted" not in c and "amt" not in c else _shown(c) for c, _ in _ASOF.values()])
    return base.join(asof.participation(ledger), "txn_id").join(asof.clustering_asof(ledger).select("txn_id", *r6("clustering_coeff_source")), "txn_id")


@query("j1_feature_merge", f"WITH {_ALL_SQL}, {PR_SQL[PR_SQL.index(', e AS') + 2:]}, x AS ({_entropy_sql(WINDOWS)}), tw AS ({_ALL_WINDOWS}) SELECT tw.*, deg_.* EXCLUDE (txn_id), part.* EXCLUDE (txn_id), cl.* EXCLUDE (txn_id), round(coalesce(a.r, 0), 9) + 0.0 AS pagerank_source, round(coalesce(b.r, 0), 9) + 0.0 AS pagerank_destination FROM tw JOIN deg_ USING (txn_id) JOIN part USING (txn_id) JOIN cl USING (txn_id) LEFT JOIN p10 a ON tw.source_id = a.id LEFT JOIN p10 b ON tw.destination_id = b.id")
def _(s, d):
    ledger = events_ledger(s, d)
    out = plans.feature_table(ledger, graph.pagerank(graph.edges(ledger), iterations=10))
    shown = [c for c, t in out.dtypes if t == "double" and c not in ("amount", "pagerank_source", "pagerank_destination")]
    return out.withColumns({c: _shown(c) for c in shown} | {c: F.round(c, 9) + F.lit(0.0) for c in ("pagerank_source", "pagerank_destination")})


def minimum_slice(s, d):
    """The flagship: window moments, as-of degrees and recurrence of every transaction."""
    bases = ("AvgAmountT", "TotalAmountT", "StdAmountT", "BiasAmountT", "NumberT")
    df = temporal.temporal_features(events_ledger(s, d), WINDOWS, bases)
    return asof.degree_features(df).drop("new_edge")
