"""Static graph: construction, centrality, components, subgraphs, histograms."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import draw
from ..runtime import cut


def edges(df: DataFrame) -> DataFrame:
    """Parallel transactions collapsed into one weighted edge."""
    return df.groupBy("source_id", "destination_id").agg(F.sum("amount").alias("total_amount"), F.count(F.lit(1)).alias("count"), F.max("txn_time").alias("last_time"))


def nodes(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("source_id", "destination_id")).alias("id")).distinct()


def degrees(e: DataFrame) -> DataFrame:
    """Distinct counterparties each way and net flow (paid out less received) of every node."""
    roles = e.select(F.expr("""inline(array(
        named_struct('id', source_id, 'o', 1L, 'i', 0L, 'flow', total_amount),
        named_struct('id', destination_id, 'o', 0L, 'i', 1L, 'flow', -total_amount)))"""))
    return roles.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum("flow").alias("net_flow"))


def pagerank(e: DataFrame, *, iterations: int | None = None, damping: float = 0.85, tol: float = 1e-6, max_iterations: int = 100) -> DataFrame:
    """Weighted PageRank (id, pagerank): dangling mass spread evenly, start 1/N, stop at an L1 change under N * tol or after `iterations`.

    Each step joins ranks with their out-edges and sums by target; the lineage is cut in the shared checkpoint folder."""
    out = e.groupBy("source_id").agg(F.sum("total_amount").alias("w"))
    links = cut(e.join(out, "source_id").select(F.col("source_id").alias("src"), F.col("destination_id").alias("dst"), (F.col("total_amount") / F.col("w")).alias("share")))
    base = cut(nodes(e).join(out.select(F.col("source_id").alias("id"), F.lit(False).alias("dangling")), "id", "left").select("id", F.coalesce("dangling", F.lit(True)).alias("dangling")))
    n = base.count()
    if not n:
        return base.select("id", F.lit(0.0).alias("pagerank"))
    ranks = base.withColumn("pagerank", F.lit(1.0 / n))
    lost = base.where("dangling").count() / n
    for _ in range(iterations or max_iterations):
        inflow = links.join(ranks, links.src == ranks.id).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("pagerank") * F.col("share")).alias("inflow"))
        new = cut(ranks.withColumnRenamed("pagerank", "old").join(inflow, "id", "left").select(
            "id", "dangling", "old", (F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("inflow", F.lit(0.0))).alias("pagerank")))
        change, lost = new.agg(F.sum(F.abs(F.col("pagerank") - F.col("old"))), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("pagerank"))), F.lit(0.0))).first()
        ranks = new.drop("old")
        if iterations is None and change < n * tol:
            break
    else:
        if iterations is None:
            raise ValueError(f"no convergence in {max_iterations} iterations")
    return ranks.select("id", "pagerank")


def node_table(e: DataFrame, ranks: DataFrame) -> DataFrame:
    return degrees(e).join(ranks, "id", "left").select("id", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"), "in_degree", "out_degree", "net_flow")


def _tarjan(adjacency: dict) -> Iterator[list]:
    """Strongly connected components, without recursion."""
    index: dict = {}
    low: dict = {}
    stack: list = []
    on: set = set()
    for root in sorted(adjacency):
        if root in index:
            continue
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        work = [(root, iter(adjacency[root]))]
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(adjacency[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    yield part


def scc(e: DataFrame, local_edges: int = 2_000_000) -> DataFrame:
    """(id, component): component is the smallest id of the strongly connected component. Graphs of more than `local_edges` edges go by joins."""
    e = e.select("source_id", "destination_id")
    kind = dict(e.dtypes)["source_id"]
    if e.limit(local_edges + 1).count() > local_edges:
        return scc_distributed(e)

    def run(batches):
        import pandas as pd

        adjacency: dict = {}
        for b in batches:
            for s, d in zip(b["source_id"].tolist(), b["destination_id"].tolist(), strict=True):
                adjacency.setdefault(s, []).append(d)
                adjacency.setdefault(d, [])
        rows = [(v, min(c)) for c in _tarjan(adjacency) for v in c]
        if rows:
            yield pd.DataFrame(rows, columns=["id", "component"])

    return e.coalesce(1).mapInPandas(run, f"id {kind}, component {kind}")


def _spread(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The least label that reaches each node along links (a, b) within its colour."""
    while True:
        offers = links.join(labels.select(F.col("id").alias("a"), F.col("label").alias("offer")), "a").groupBy(F.col("b").alias("id")).agg(F.min("offer").alias("offer"))
        new = cut(labels.join(offers, "id", "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("offer", "label")).alias("label")))
        labels = new.select("id", "label")
        if new.where("label < old").isEmpty():
            return labels


def scc_distributed(e: DataFrame) -> DataFrame:
    """Forward colours by least reachable-from label, then backward confirmation within a colour; repeated on what is left."""
    links = cut(e.where("source_id <> destination_id").select(F.col("source_id").alias("a"), F.col("destination_id").alias("b")).distinct())
    left, done = cut(nodes(e)), None
    while not left.isEmpty():
        fwd = _spread(left.withColumn("label", F.col("id")), links)
        ca, cb = fwd.select(F.col("id").alias("a"), F.col("label").alias("la")), fwd.select(F.col("id").alias("b"), F.col("label").alias("lb"))
        same = cut(links.join(ca, "a").join(cb, "b").where("la = lb").select("a", "b"))
        back = _spread(fwd.select("id", F.when(F.col("id") == F.col("label"), F.struct(F.lit(0).alias("k"), F.col("id").alias("v"))).otherwise(F.struct(F.lit(1).alias("k"), F.col("id").alias("v"))).alias("label")), same.select(F.col("b").alias("a"), F.col("a").alias("b")))
        found = back.join(fwd.withColumnRenamed("label", "component"), "id").where("label.k = 0").select("id", "component")
        done = found if done is None else done.unionByName(found)
        done = cut(done)
        left = cut(left.join(done, "id", "left_anti"))
        links = cut(links.join(left.withColumnRenamed("id", "a"), "a", "left_semi").join(left.withColumnRenamed("id", "b"), "b", "left_semi"))
    return done if done is not None else left.select("id", F.col("id").alias("component"))


def _numbered(ids: DataFrame) -> tuple[DataFrame, int]:
    """ids(id) plus `at`, dense from 0, and their number; only the count of each partition reaches the driver."""
    placed = cut(ids.select("id", F.monotonically_increasing_id().alias("_at")))
    part, place = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = dict(placed.groupBy(part).agg(F.count(F.lit(1))).collect())
    starts = list(accumulate((sizes.get(p, 0) for p in range(max(sizes, default=0))), initial=0))
    return placed.select("id", (F.get(F.lit(starts), part) + place).alias("at")), sum(sizes.values())


def _packed(batches):
    """Blocks of (u, v, cost) as bytes."""
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).astype(t).tobytes()], pa.binary()) for c, t in zip(b.columns, ("<i4", "<i4", "<f8"), strict=True)], ["u", "v", "cost"])


def betweenness(e: DataFrame, *, sources: int | None = None, seed: int = 42, max_edges: int = 5_000_000) -> DataFrame:
    """Weighted betweenness (total_amount as distance): Brandes from each source in parallel; `sources` samples the starts.

    Only edges that leave a node which some other node pays go to every worker, as arrays of 12 bytes an edge, so their
    number is checked; a start that nobody pays brings its own edges in its row. Ids stay on the executors."""
    import numpy as np

    spark = e.sparkSession
    every = cut(nodes(e))
    n = every.count()
    other = e.where("source_id <> destination_id").select("source_id", "destination_id", "total_amount")
    paid, n_paid = _numbered(other.select(F.col("destination_id").alias("id")).distinct())
    ends = other.join(paid.select(F.col("id").alias("destination_id"), F.col("at").alias("v")), "destination_id")
    links = cut(ends.join(paid.select(F.col("id").alias("source_id"), F.col("at").alias("u")), "source_id", "left")
                .select("source_id", "u", "v", F.col("total_amount").cast("double").alias("cost")))
    shared_links = links.where("u IS NOT NULL").select("u", "v", "cost")
    if shared_links.limit(max_edges + 1).count() > max_edges:
        raise ValueError(f"more than {max_edges} edges leave nodes that others pay; every worker would hold them")
    blocks = shared_links.orderBy("u").mapInArrow(_packed, "u binary, v binary, cost binary").collect()
    u, v, cost = (np.concatenate([np.zeros(0, t), *[np.frombuffer(b[i], t) for b in blocks]]) for i, t in enumerate(("<i4", "<i4", "<f8")))
    del blocks
    first = np.zeros(n_paid + 1, np.int64)
    np.cumsum(np.bincount(u, minlength=n_paid), out=first[1:])
    del u
    shared = spark.sparkContext.broadcast((first, v, cost))
    starts = every if sources is None else every.orderBy(F.rand(seed)).limit(sources)
    scale = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0) * (n / min(n, sources) if sources else 1.0)
    own = links.where("u IS NULL").groupBy(F.col("source_id").alias("id")).agg(F.collect_list(F.struct("v", "cost")).alias("_l")).select("id", F.col("_l.v").alias("to"), F.col("_l.cost").alias("cost"))
    starts = starts.join(paid, "id", "left").join(own, "id", "left").select("id", F.coalesce("at", F.lit(-1)).alias("at"), "to", "cost")

    def run(batches):
        import heapq
        from array import array

        import pandas as pd

        first, to, cost = shared.value
        total = array("d", bytes(8 * n_paid))
        near: dict = {}
        held = 0

        def links_of(x):
            """Edges of a node that others pay; lists of the first half million edges met are kept."""
            nonlocal held
            if x in near:
                return near[x]
            a, b = int(first[x]), int(first[x + 1])
            out = list(zip(to[a:b].tolist(), cost[a:b].tolist(), strict=True))
            if held + len(out) <= 500_000:
                near[x] = out
                held += len(out)
            return out

        for batch in batches:
            for s, own_to, own_cost in zip(batch["at"].tolist(), batch["to"], batch["cost"], strict=True):
                own_links = () if own_to is None else list(zip(own_to.tolist(), own_cost.tolist(), strict=True))
                dist, sigma, parents, order, heap, tie = {}, {s: 1.0}, {s: []}, [], [(0.0, 0, s)], 1
                seen = {s: 0.0}
                while heap:
                    d, _, v = heapq.heappop(heap)
                    if v in dist:
                        continue
                    dist[v] = d
                    order.append(v)
                    for w, c in own_links if v < 0 else links_of(v):
                        nd = d + c
                        if w not in dist and (w not in seen or nd < seen[w]):
                            seen[w] = nd
                            heapq.heappush(heap, (nd, tie, w))
                            tie += 1
                            sigma[w], parents[w] = sigma[v], [v]
                        elif w not in dist and nd == seen[w]:
                            sigma[w] += sigma[v]
                            parents[w].append(v)
                gain = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in parents[w]:
                        gain[v] += sigma[v] / sigma[w] * (1 + gain[w])
                    if w != s:
                        total[w] += gain[w]
        part = np.frombuffer(total, "<f8")
        some = np.flatnonzero(part)
        for lo in range(0, len(some), 10_000):
            at = some[lo:lo + 10_000]
            yield pd.DataFrame({"at": at, "part": part[at]})

    parts = starts.repartition(spark.sparkContext.defaultParallelism, "id").mapInPandas(run, "at long, part double")
    sums = parts.groupBy("at").agg((F.sum("part") * scale).alias("betweenness")).join(paid, "at").select("id", "betweenness")
    return every.join(sums, "id", "left").na.fill(0.0, ["betweenness"])


def component_sizes(c: DataFrame) -> DataFrame:
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def induced(e: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends in keep(id)."""
    return e.join(keep.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(keep.select(F.col("id").alias("destination_id")), "destination_id", "left_semi")


def top_components(e: DataFrame, components: DataFrame, k: int = 4) -> DataFrame:
    """Edges inside each of the k largest components."""
    top = component_sizes(components).orderBy(F.desc("size"), "component").limit(k)
    kept = components.join(F.broadcast(top), "component")
    a = kept.select(F.col("id").alias("source_id"), "component", "size")
    b = kept.select(F.col("id").alias("destination_id"), F.col("component").alias("other"))
    return e.join(a, "source_id").join(b, "destination_id").where("component = other").drop("other")


def top_subgraph(e: DataFrame, ranks: DataFrame, max_nodes: int = 200, max_edges: int = 500) -> DataFrame:
    """The heaviest edges among the nodes of the highest PageRank."""
    keep = ranks.orderBy(F.desc("pagerank"), "id").limit(max_nodes)
    return induced(e, keep).orderBy(F.desc("total_amount"), "source_id", "destination_id").limit(max_edges)


def sampled_nodes(e: DataFrame, k: int, seed: int) -> DataFrame:
    """Half of the highest degree, half drawn from the rest."""
    deg = degrees(e).select("id", (F.col("in_degree") + F.col("out_degree")).alias("deg"))
    top = deg.orderBy(F.desc("deg"), "id").limit(k // 2)
    rest = deg.join(top, "id", "left_anti").orderBy(draw(seed, F.col("id")), "id").limit(k - k // 2)
    return top.select("id").union(rest.select("id")).distinct()


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """(bin, n): equal-width bins, left-closed, the last one closed; a constant column falls in the middle as numpy widens it by a half each way."""
    x = F.col(value).cast("double")
    edge = df.agg(F.min(x).alias("mn"), F.max(x).alias("mx")).select(
        F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")).alias("mn"), F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx")).alias("mx"))
    placed = df.select(x.alias("x")).where("x is not null").join(F.broadcast(edge))
    return placed.groupBy(F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("mn")) / (F.col("mx") - F.col("mn")) * bins)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def summary_histograms(e: DataFrame, ranks: DataFrame, bins: int = 50) -> DataFrame:
    """(measure, bin, n): degrees both ways, PageRank, component sizes and net flow. Sums are rounded, so that no bin hangs on their order."""
    n = node_table(e, ranks).select("id", "in_degree", "out_degree", F.round("pagerank", 9).alias("pagerank"), F.round("net_flow", 6).alias("net_flow"))
    sizes = component_sizes(scc(e)).withColumnRenamed("size", "component_size")
    out = None
    for df, measure in ((n, "in_degree"), (n, "out_degree"), (n, "pagerank"), (sizes, "component_size"), (n, "net_flow")):
        one = histogram(df, measure, bins).select(F.lit(measure).alias("measure"), "bin", "n")
        out = one if out is None else out.unionByName(one)
    return out


def visual_attributes(e: DataFrame, n: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edge widths, node colours and tooltips; one-row maxima are broadcast."""
    top = e.agg(F.coalesce(F.max("total_amount"), F.lit(1.0)).alias("mx"))
    span = n.agg(F.min("pagerank").alias("lo"), F.max("pagerank").alias("hi"))
    ee = e.join(F.broadcast(top)).select("source_id", "destination_id", "total_amount", "count",
        (1 + 5 * F.log1p("total_amount") / F.log1p("mx")).alias("width"), (0.5 + 2 * F.log1p("total_amount") / F.log1p("mx")).alias("thin_width"),
        F.format_string("Amount: %.2f<br>Count: %d", "total_amount", "count").alias("title"))
    nn = n.join(F.broadcast(span)).select("id", "pagerank",
        F.when(F.col("hi") > F.col("lo"), (F.col("pagerank") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0).alias("value"),
        F.format_string("rgba(255, %d, 0, 0.8)", F.greatest(F.lit(0), (255 * (1 - 10 * F.col("pagerank"))).cast("int"))).alias("color"),
        F.format_string("Node: %s<br>PageRank: %.4f<br>Degree: %d/%d", F.col("id").cast("string"), "pagerank", "in_degree", "out_degree").alias("title"))
    return ee, nn
