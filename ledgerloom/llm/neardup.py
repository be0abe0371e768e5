"""MinHash near-dedup on SetSketch registers: bands, joint likelihood, exact verification, components.

1. Documents with equal shingle sets are one class, known by the first 64 bits of its set's hash from here on.
2. Bands of registers give buckets. Every member is compared with its bucket's least class, so candidates grow with the
   members of a bucket and not with its pairs.
3. What verified links leave apart in a bucket is compared again: members outside the bucket's main component, in blocks,
   with all members of other components. So every pair that shares a band is linked, settled by a path, or tested.
4. Every candidate is tested on full sets, unless the sizes alone rule it out. Estimates only order the tests in a block, so
   that likely links come first and spare later ones."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, fresh, mix, trimmed
from .sketches import Shingler, band_keys, joint_estimate, sketches

LEAST = -(1 << 63)
#: Members outside the main component that a task compares, and members that it compares them with; and the shingles of either, 8 bytes each.
QUERIES, ROWS = 4096, 16384
QUERY_SHINGLES, ROW_SHINGLES = 2_000_000, 8_000_000


def _sketch(size: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        shingle = Shingler(size)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = [shingle(raw) if raw is not None else np.zeros(0, np.uint64) for raw in (t.as_buffer() for t in part.column("text"))]
                full = [i for i, s in enumerate(sets) if len(s)]
                registers = [None] * len(sets)
                if full:
                    for i, r in zip(full, sketches([sets[i] for i in full]), strict=True):
                        registers[i] = r.tobytes()
                marks = [_identity(s) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("__id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in marks], pa.int64()), pa.array([b for _, b in marks], pa.int64()), pa.array(registers, pa.binary())], ["__id", "n", "f1", "f2", "registers"])

    return run


def _identity(s) -> tuple[int, int]:
    """128 bits that equal sets share."""
    import numpy as np

    a = np.array([mix(s).sum(dtype=np.uint64), mix(s * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)], np.uint64).view(np.int64)
    return int(a[0]), int(a[1])


def _bands(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        registers = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        keys = band_keys(registers).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *[pa.array(np.repeat(batch.column(c).to_numpy(), keys.shape[1])) for c in ("rep", "n")]], ["band", "rep", "n"])


def _sets(size: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingle = Shingler(size)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                made = [(rep, s.tobytes()) for rep, t in zip(part.column("rep").to_pylist(), part.column("text"), strict=True) if _identity(s := shingle(t.as_buffer()))[0] == rep]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in made], pa.int64()), pa.array([s for _, s in made], pa.binary())], ["rep", "set"])

    return run


def _common(a, b) -> int:
    """Members that two sorted arrays share."""
    import numpy as np

    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _linked(a, b, per_cent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < per_cent * large:
        return False
    both = _common(a, b)
    return 100 * both >= per_cent * (len(a) + len(b) - both)


def _verify(per_cent: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            a, b = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in ("set_a", "set_b"))
            hit = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if _linked(x, y, per_cent)]
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(hit, pa.int64())), batch.column("b").take(pa.array(hit, pa.int64()))], ["a", "b"])

    return run


def _rest(per_cent: int):
    """Links across components within a block, rows sorted by block: queries against all, each pair in the first band that it shares."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        block: list[dict] = []

        def done(rows):
            found = _cross(rows, per_cent)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for row in batch.to_pylist():
                if block and any(row[k] != block[0][k] for k in ("band", "i", "j")):
                    yield done(block)
                    block = []
                block.append(row)
        if block:
            yield done(block)

    return run


def _cross(rows: list[dict], per_cent: int) -> list[tuple[int, int]]:
    import numpy as np

    queries, every = [r for r in rows if r["query"]], [r for r in rows if not r["query"]]
    if not queries or not every:
        return []
    registers = np.frombuffer(b"".join(r["registers"] for r in every), np.uint8).reshape(len(every), -1)
    keys, band = band_keys(registers), np.uint64(rows[0]["band"] & ((1 << 64) - 1))
    n, ids, component = (np.array([r[k] for r in every]) for k in ("n", "rep", "component"))
    sets = [np.frombuffer(r["set"], np.uint64) for r in every]
    parent: dict[int, int] = {}

    def root(c):
        while (p := parent.get(c, c)) != c:
            c = p
        return c

    found = []
    for q in queries:
        own = np.frombuffer(q["registers"], np.uint8)[None]
        fit = (component != q["component"]) & (100 * np.minimum(n, q["n"]) >= per_cent * np.maximum(n, q["n"]))
        # A pair of two queries of this bucket is left to the one of the smaller id.
        fit &= ~np.array([r["minor"] for r in every]) | (ids > q["rep"])
        at = np.flatnonzero(fit)
        if not len(at):
            continue
        shared = keys[at] == band_keys(own)
        at = at[keys[at, shared.argmax(1)] == band]
        if not len(at):
            continue
        score = joint_estimate(np.broadcast_to(own, (len(at), own.shape[1])), registers[at], np.full(len(at), float(q["n"])), n[at].astype(float))
        mine = np.frombuffer(q["set"], np.uint64)
        for k in at[np.argsort(-score, kind="stable")].tolist():
            a, b = root(q["component"]), root(int(component[k]))
            if a != b and _linked(mine, sets[k], per_cent):
                parent[max(a, b)] = min(a, b)
                found.append((min(q["rep"], int(ids[k])), max(q["rep"], int(ids[k]))))
    return found


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that links (a, b) reach, for every node with a link. Alternates large-star and small-star steps until the edges stay."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        mark = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))).alias("h")).first()
        if mark == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        edges = cut(joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct())


def near_duplicates(docs: DataFrame, size: int = 3, per_cent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row a row of docs(doc_id, text).

    Documents are linked if 100 * intersection >= per_cent * union of their sets of `size`-word shingles; texts of fewer words
    are one shingle, texts without words are linked with nothing. component_id is the least id that links reach; null ids
    count as least and come back null. Rows of one id with different texts are told apart, though components only name the id."""
    found = _components(docs, size, per_cent)
    back = F.when(F.col("component") != LEAST, F.col("component"))
    out = found.select(F.when(F.col("__id") != LEAST, F.col("__id")).alias("doc_id"), F.col("n").alias("n_shingles"), back.alias("component_id"), (F.col("__id") == F.col("component")).alias("kept"))
    return out


def _components(docs: DataFrame, size: int, per_cent: int) -> DataFrame:
    """(__id, n, component) of every row."""
    here = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("__id"), "text")
    rows = cut(here.mapInArrow(trimmed(_sketch(size)), "__id long, n long, f1 long, f2 long, registers binary"))
    classes = rows.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("__id").alias("id"), F.min("registers").alias("registers"))
    reps = classes.select(F.col("f1").alias("rep"), "n", "registers")
    bands = reps.mapInArrow(trimmed(_bands), "band long, rep long, n long")
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("s"), F.min("rep").alias("centre"))
    members = cut(bands.join(sizes.where("s > 1"), "band"))
    involved = cut(members.select("rep").distinct())
    sketched = cut(reps.join(involved, "rep").dropDuplicates(["rep"]))
    wanted = classes.select(F.col("f1").alias("rep"), F.col("id").alias("__id")).join(involved, "rep")
    texts = here.where("text is not null").join(wanted, "__id")
    sets = cut(texts.select("rep", "text").mapInArrow(trimmed(_sets(size)), "rep long, set binary").dropDuplicates(["rep"]))

    pairs = members.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    a, b = (sketched.select(F.col("rep").alias(k), F.col("n").alias(f"n{k}")) for k in "ab")
    fit = pairs.join(b, "b").join(a, "a").where(100 * F.least("na", "nb") >= per_cent * F.greatest("na", "nb")).select("a", "b")
    sa, sb = (sets.select(F.col("rep").alias(k), F.col("set").alias(f"set_{k}")) for k in "ab")
    links = cut(fit.join(sb, "b").join(sa, "a").mapInArrow(trimmed(_verify(per_cent)), "a long, b long"))

    more = cut(_more_links(members, components(links), sketched, sets, per_cent))
    final = components(links.unionByName(more))
    labelled = classes.select("f1", "f2", "n", "id", F.col("f1").alias("node")).join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min("id").alias("least"))
    labelled = labelled.join(least, "component").select("f1", "f2", "n", "least")
    out = rows.select("__id", "n", "f1", "f2").join(labelled, ["f1", "f2", "n"], "left")
    return out.select("__id", "n", F.coalesce("least", "__id").alias("component"))


def _more_links(members: DataFrame, found: DataFrame, sketched: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Links between components that meet in a bucket."""
    placed = members.select("band", "rep", "n").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    counts = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("cn"))
    main = counts.groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("all"), F.sum("cn").alias("all_n"), F.max(F.struct("c", "component", "cn")).alias("top")).where("k > 1 AND all > 2")
    parts = lambda count, most, size, bytes_: F.ceil(F.greatest(count / most, size / bytes_)).cast("int")
    main = main.select("band", F.col("top.component").alias("main"), parts(F.col("all") - F.col("top.c"), QUERIES, F.col("all_n") - F.col("top.cn"), QUERY_SHINGLES).alias("ni"), parts(F.col("all"), ROWS, F.col("all_n"), ROW_SHINGLES).alias("nj"))
    rest = placed.join(main, "band")
    rest = rest.select("band", "rep", "component", (F.col("component") != F.col("main")).alias("minor"),
        "ni", "nj", F.xxhash64("rep").alias("h"))
    mine_i, mine_j = F.pmod("h", "ni").cast("int"), F.pmod(F.shiftright("h", 20), F.col("nj")).cast("int")
    as_row = F.transform(F.sequence(F.lit(0), F.col("ni") - 1), lambda i: F.struct(i.alias("i"), mine_j.alias("j"), F.lit(False).alias("query")))
    as_query = F.when(F.col("minor"), F.transform(F.sequence(F.lit(0), F.col("nj") - 1), lambda j: F.struct(mine_i.alias("i"), j.alias("j"), F.lit(True).alias("query")))).otherwise(F.slice(as_row, 1, 0))
    dealt = rest.select("band", "rep", "component", "minor", F.explode(F.concat(as_row, as_query)).alias("to")).select("band", "rep", "component", "minor", "to.*")
    full = dealt.join(sketched, "rep").join(sets, "rep")
    return full.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").select("band", "i", "j", "query", "minor", "rep", "component", "n", "registers", "set").mapInArrow(trimmed(_rest(per_cent)), "a long, b long").distinct()


def one_of_each(docs: DataFrame, size: int = 5, per_cent: int = 80) -> DataFrame:
    """The rows of docs whose id is its component's least, with their columns, whatever their names; texts without words stay.

    Rows of one id stay or go together, so equal rows stay both. Rows without an id count as least and all stay."""
    key, = fresh(docs, "key")
    kept = _components(docs.select("doc_id", "text"), size, per_cent).where("__id = component").select(F.col("__id").alias(key)).distinct()
    return docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))).join(kept, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
