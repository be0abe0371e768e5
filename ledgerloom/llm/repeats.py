"""Exact repeats of fixed length across documents: what suffix-array and FM-index dedup share.

Every window of `length` symbols is represented by its minimiser, the least hash among its grams of `gram` symbols, the
rightmost of equals. Equal windows have equal minimisers at equal places, so grouping minimisers by hash brings all their
occurrences together, at two rows or so per window length instead of one a symbol. Consecutive windows with one minimiser
form a stretch. Equal stretches, by a 96-bit hash beside the gram's 64 bits, are settled without looking at the text. Only
stretches that share a gram but differ are read, and a local index finds their common windows exactly. Where more than
`CROWD` of them share a gram, as around a passage that very many documents embed, they are first parted by `_part`, round by
round, until no index holds more. Grams of more than `HOT` occurrences never meet in one task: their stretches are counted by
partial aggregates and joined back, and AQE splits what is skewed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, mix, randoms, sliced, small, span_hashes, trimmed, word_spans

#: Fixed odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Symbols that are hashed at once; longer documents go in overlapping parts.
PART = 1 << 20
LEAST = -(1 << 63)
#: Stretches of one gram that an index takes at once; beyond that they are parted, into PARTS ranges of windows a round.
CROWD, PARTS = 4096, 4
#: Occurrences of a gram from which on it is hot: all occurrences over HOT bounds how many such grams there can be.
HOT = 4_000_000
#: One document in so many is scanned to find hot grams. That only chooses between two exact ways, so no row hangs on it.
GLANCE = 64
#: Bytes of stretches after which an index is closed at the next gram.
SHARD = 500_000
#: A row's key: its id and 64 bits of its text, 128 bits where there is no id.
KEY = ("__id", "__rk", "__rj")
ROW = "__id long, __rk long, __rj long"
OCCURRENCE = "__id:long, __rk:long, __rj:long, pos:long"


@dataclass(frozen=True)
class Unit:
    """Symbols ('bytes' or 'words'), the window's length and the gram's."""

    kind: str
    length: int
    gram: int


class Hasher:
    """Prefix sums of symbol * base ** place, whose differences give the hash of any stretch."""

    def __init__(self):
        self.size, self.powers, self.inverses = 0, [], []
        self.bytes = randoms(256, 3)
        self.place = randoms(64, 7)

    def grow(self, n: int) -> None:
        import numpy as np

        if n <= self.size:
            return
        self.size, self.powers, self.inverses = max(n, 1 << 14), [], []
        for base in BASES:
            for value, out in ((base, self.powers), (pow(base, -1, 1 << 64), self.inverses)):
                p = np.full(self.size + 1, value, np.uint64)
                p[0] = 1
                out.append(np.cumprod(p))

    def symbols(self, raw, kind: str):
        """uint64 symbols of a byte buffer, and for words where each starts and ends."""
        import numpy as np

        data = np.frombuffer(raw, np.uint8)
        if kind == "bytes":
            return self.bytes[data], None
        spans = word_spans(data)
        hashes, self.place = span_hashes(data, *spans, self.bytes, self.place)
        return hashes, spans

    def prefix(self, symbols, which: int):
        import numpy as np

        self.grow(len(symbols))
        out = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self.powers[which][: len(symbols)], out=out[1:])
        return out

    def stretch(self, prefix, start, end, which: int):
        return mix((prefix[end] - prefix[start]) * self.inverses[which][start])


def minimisers(values, w: int):
    """For every window of w values, the place of the least one, the rightmost of equals."""
    import numpy as np

    n = len(values)
    low = np.uint64((1 << 21) - 1)
    v = (values & ~low) | (low - np.arange(n, dtype=np.uint64))
    blocks = -(-n // w)
    full = np.full(blocks * w, np.iinfo(np.uint64).max)
    full[:n] = v
    full = full.reshape(blocks, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return (low - (np.minimum(back[: n - w + 1], ahead[w - 1 : n]) & low)).astype(np.int64)


def stretches(h: Hasher, symbols, unit: Unit):
    """(gram hash, stretch hashes, first window, last window) of a document's minimisers."""
    import numpy as np

    out = []
    for at in range(0, max(len(symbols) - unit.length + 1, 0), PART):
        part = symbols[at : at + PART + unit.length - 1]
        prefix = h.prefix(part, 0)
        m = len(part) - unit.gram + 1
        grams = h.stretch(prefix, np.arange(m), np.arange(unit.gram, unit.gram + m), 0)
        place = minimisers(grams, unit.length - unit.gram + 1)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:] - 1, len(place) - 1]
        end = last + unit.length
        c1 = h.stretch(prefix, first, end, 0)
        c2 = h.stretch(h.prefix(part, 1), first, end, 1)
        out.append((grams[place[first]], c1 ^ mix((end - first).astype(np.uint64)), c2 >> np.uint64(32), first + at, last + at))
    if not out:
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e.astype(np.uint64), e.astype(np.uint64), e, e
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def keyed(docs: DataFrame) -> DataFrame:
    """(row, text, __id, __rk, __rj) of docs(doc_id, text, ...): whole rows as structs, so that no column of theirs can clash, and their keys. text is for scans; whoever moves rows drops it.

    `__id` is never null (null counts as the least id). Rows with equal keys are copies and fare alike."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("__id"),
        F.xxhash64(text).alias("__rk"), F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(7), text)).otherwise(F.lit(0).cast("long")).alias("__rj"))


def _scan(unit: Unit) -> Callable[[Iterator], Iterator]:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        h = Hasher()
        for batch in batches:
            keys, texts = [batch.column(k) for k in KEY], batch.column("text")
            rows = []
            size = 0
            for i in range(batch.num_rows):
                raw = texts[i].as_buffer()
                if raw is None or raw.size < unit.length:
                    continue
                symbols, _ = h.symbols(raw, unit.kind)
                if len(symbols) >= unit.length:
                    found = stretches(h, symbols, unit)
                    rows.append((i, *found))
                    size += len(found[0])
                if size > 200_000:
                    yield emit(rows, keys)
                    rows, size = [], 0
            if rows:
                yield emit(rows, keys)

    def emit(rows, keys):
        """A row for each distinct stretch of some documents: its first occurrence, and the rest as a list. Copies and periodic texts shrink before they are shuffled."""
        import numpy as np
        import pyarrow as pa

        owner = np.repeat([r[0] for r in rows], [len(r[1]) for r in rows])
        gram, c1, c2, first, last = (np.concatenate([r[k] for r in rows]) for k in range(1, 6))
        where = [*[k.to_numpy()[owner] for k in keys], (first << 21) | (last - first)]
        order = np.lexsort((*where[::-1], c2, c1, gram))
        gram, c1, c2, *where = (x[order] for x in (gram, c1, c2, *where))
        new = np.r_[True, (gram[1:] != gram[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])]
        head, more = np.flatnonzero(new), np.flatnonzero(~new)
        n = np.diff(np.r_[head, len(new)])
        rest = pa.StructArray.from_arrays([pa.array(x[more]) for x in where], [*KEY, "pos"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n - 1)].astype(np.int32)), rest, mask=pa.array(n == 1))
        return pa.RecordBatch.from_arrays([pa.array(gram[head].view(np.int64)), pa.array(c1[head].view(np.int64)), pa.array(c2[head].astype(np.int64).astype(np.int32)), pa.array(n.astype(np.int64)), *[pa.array(x[head]) for x in where], lists], ["gram", "c1", "c2", "n", *KEY, "pos", "rest"])

    return run


def _contexts(unit: Unit) -> Callable[[Iterator], Iterator]:
    """The bytes of the stretches that are to be compared."""
    def run(batches):
        import pyarrow as pa

        h = Hasher()
        names = CONTEXT.names
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                raw = batch.column("text")[i].as_buffer()
                key = [batch.column(k)[i].as_py() for k in KEY]
                spans = h.symbols(raw, unit.kind)[1] if unit.kind == "words" else None
                for item in batch.column("asked")[i].as_py():
                    first, n = item["pos"] >> 21, (item["pos"] & ((1 << 21) - 1)) + 1
                    end = first + n + unit.length - 1
                    a, b = (first, end) if spans is None else (int(spans[0][first]), int(spans[1][end - 1]))
                    rows.append((item["gram"], raw.slice(a, b - a).to_pybytes(), *key, first, n, item["fresh"], item["crowded"]))
                    size += b - a
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=CONTEXT)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=CONTEXT)

    import pyarrow as pa

    CONTEXT = pa.schema([("gram", pa.int64()), ("bytes", pa.binary()), *[(k, pa.int64()) for k in (*KEY, "first", "windows")], ("fresh", pa.bool_()), ("crowded", pa.bool_())])
    return run


def _part(unit: Unit, size: int) -> Callable[[Iterator], Iterator]:
    """Every stretch as pieces of at most `size` windows, keyed by what all windows of a piece's range contain.

    A window is told by where its minimiser stands in it, so equal windows fall into one range, and the core of that range is
    a part of both: they meet under one key. A range of one window has the window itself as its core."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        h = Hasher()
        schema = pa.schema([*[(k, pa.int64()) for k in ("k1", "k2", "s1", "s2")], ("bytes", pa.binary()), *[(k, pa.int64()) for k in (*KEY, "first", "windows")], ("fresh", pa.bool_())])
        for batch in batches:
            rows, held = [], 0
            for row in batch.to_pylist():
                raw = row["bytes"]
                symbols, spans = h.symbols(raw, unit.kind)
                p0, p1 = h.prefix(symbols, 0), h.prefix(symbols, 1)
                # The minimiser of the first window is that of all.
                start = np.arange(unit.length - unit.gram + 1)
                place = int(minimisers(h.stretch(p0, start, start + unit.gram, 0), len(start))[0])
                within = place - np.arange(row["windows"])
                block = within // size
                lo = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
                hi = np.r_[lo[1:], len(block)]
                # Windows of the range start from `far` to `near`, whether or not this stretch has them all.
                near = place - block[lo] * size
                far = np.maximum(near - size + 1, place - len(start) + 1)
                core = near, far + unit.length
                end = hi - 1 + unit.length
                mark = mix(block[lo].astype(np.uint64))
                k1, k2 = h.stretch(p0, *core, 0) ^ mark, h.stretch(p1, *core, 1)
                s1, s2 = h.stretch(p0, lo, end, 0) ^ mix(within[lo].astype(np.uint64) << np.uint64(32) | (hi - lo).astype(np.uint64)), h.stretch(p1, lo, end, 1)
                hashes = [x.view(np.int64).tolist() for x in (k1, k2, s1, s2)]
                for i, (f, e) in enumerate(zip(lo.tolist(), end.tolist(), strict=True)):
                    x, y = (f, e) if spans is None else (int(spans[0][f]), int(spans[1][e - 1]))
                    rows.append([*[v[i] for v in hashes], raw[x:y], *[row[k] for k in KEY], row["first"] + f, int(hi[i]) - f, row["fresh"]])
                    held += y - x
                if held > 4_000_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return run


def _parted(crowds: DataFrame, unit: Unit, ordered: bool, crowd: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Stretches of crowded grams as (settled runs, pieces for an index): logarithmically many rounds, each of some PARTS slim rows a stretch."""
    runs, left = [], []
    size = unit.length - unit.gram + 1
    while size > 1 and not crowds.isEmpty():
        size = -(-size // PARTS)
        occurrence = F.struct(*KEY, "first")
        found = cut(crowds.select("bytes", *KEY, "first", "windows", "fresh").mapInArrow(trimmed(_part(unit, size)), f"k1 long, k2 long, s1 long, s2 long, bytes binary, {ROW}, first long, windows long, fresh boolean"))
        # Partial aggregates, not windows: a core that very many stretches share must not be one task.
        pieces = found.groupBy("k1", "k2", "s1", "s2").agg(F.count(F.lit(1)).alias("total"), F.min(occurrence).alias("least"), F.max("fresh").alias("any"))
        cores = pieces.groupBy("k1", "k2").agg(((F.count(F.lit(1)) > 1) & (F.lit(ordered) | F.max(F.col("any") & (F.col("total") == 1)))).alias("several"), (F.sum("total") > crowd).alias("crowded"))
        found = found.join(pieces.join(cores, ["k1", "k2"]).drop("any"), ["k1", "k2", "s1", "s2"])
        if ordered:
            settled, fresh = F.col("__id") > F.col("least.__id"), F.lit(True)
            asked = F.col("several") & ~settled
        else:
            settled, fresh = F.col("fresh") & (F.col("total") > 1), F.col("fresh") & (F.col("total") == 1)
            asked = F.col("several") & (occurrence == F.col("least"))
        found = cut(found.select(F.col("k1").alias("gram"), "bytes", *KEY, "first", "windows", fresh.alias("fresh"), settled.alias("settled"), asked.alias("asked"), "crowded").where("settled OR asked"))
        runs.append(found.where("settled").select(*KEY, F.col("first").alias("start"), (F.col("first") + F.col("windows") - 1 + unit.length).alias("end")))
        asked_ = found.where("asked").drop("settled", "asked")
        left.append(asked_.where("NOT crowded"))
        crowds = asked_.where("crowded")
    return runs, left


def _resolve(unit: Unit, index: Callable) -> Callable[[Iterator], Iterator]:
    """Stretches sorted by gram, in shards of whole grams, through `index(hasher, rows) -> [(row, a, b)]`, runs of windows to remove."""
    def run(batches):
        import pyarrow as pa

        h = Hasher()
        shard: list[dict] = []

        def flush(rows):
            out = [(*[rows[r][k] for k in KEY], rows[r]["first"] + a, rows[r]["first"] + b + unit.length) for r, a, b in index(h, rows)]
            cols = list(zip(*out, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [*KEY, "start", "end"])

        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if size > SHARD and row["gram"] != shard[-1]["gram"]:
                    yield flush(shard)
                    shard, size = [], 0
                shard.append(row)
                size += len(row["bytes"])
        if shard:
            yield flush(shard)

    return run


def repeated(docs: DataFrame, unit: Unit, index: Callable, ordered: bool, crowd: int = CROWD, hot: int | None = None) -> DataFrame:
    """(__id, __rk, __rj, __spans): stretches of symbols under windows that also start elsewhere (or, if `ordered`, in a document of a smaller id). docs is `keyed`."""
    stretch = Window.partitionBy("gram", "c1", "c2")
    gram = Window.partitionBy("gram")
    here = docs.select(*KEY, "text")
    scan = lambda rows: rows.mapInArrow(trimmed(_scan(unit)), f"gram long, c1 long, c2 int, n long, {OCCURRENCE.replace(':', ' ')}, rest array<struct<{OCCURRENCE}>>")
    found, glance = scan(here), scan(here if hot else here.where(F.rand(11) < 1 / GLANCE))
    occurrence = F.struct(*KEY, "pos")
    hot_grams = cut(glance.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > (hot or HOT / GLANCE)).select("gram"))
    some = not hot_grams.isEmpty()
    plain = found.join(small(hot_grams, 1_000_000), "gram", "left_anti") if some else found
    # Its first occurrence is the least of a row.
    plain = plain.withColumns({"total": F.sum("n").over(stretch), "least": F.min(occurrence).over(stretch)})
    plain = plain.withColumn("several", (F.min("c1").over(gram) != F.max("c1").over(gram)) & (F.lit(ordered) | (F.min("total").over(gram) == 1)))
    plain = plain.withColumn("crowded", F.count(F.lit(1)).over(gram) > crowd)
    cols = ["gram", *KEY, "pos", "rest", "total", "least", "several", "crowded"]
    every = plain.select(*cols)
    if some:
        much = found.join(small(hot_grams, 1_000_000), "gram", "left_semi")
        kinds = much.groupBy("gram", "c1", "c2").agg(F.sum("n").alias("total"), F.min(occurrence).alias("least"))
        per = kinds.groupBy("gram").agg(((F.count(F.lit(1)) > 1) & (F.lit(ordered) | (F.min("total") == 1))).alias("several"), (F.count(F.lit(1)) > crowd).alias("crowded"))
        every = every.unionByName(much.join(kinds.join(small(cut(per), 1_000_000), "gram"), ["gram", "c1", "c2"]).select(*cols))
    every = every.where(F.col("several") | (F.col("total") > 1))
    members = every.select("gram", "total", "least", "several", "crowded", F.explode(F.concat(F.array(occurrence), F.coalesce("rest", F.array().cast(f"array<struct<{OCCURRENCE}>>")))).alias("o")).select("gram", "total", "least", "several", "crowded", "o.*")
    if ordered:
        settled, fresh = F.col("__id") > F.col("least.__id"), F.lit(True)
        asked = F.col("several") & ~settled
    else:
        settled, fresh = F.col("total") > 1, F.col("total") == 1
        asked = F.col("several") & (occurrence == F.col("least"))
    marks = cut(members.select(*KEY, "pos", "gram", settled.alias("settled"), asked.alias("asked"), fresh.alias("fresh"), "crowded").where("settled OR asked"))

    # Crowded or not, texts are joined once.
    wanted = marks.where("asked").groupBy(*KEY).agg(F.collect_set(F.struct("gram", "pos", "fresh", "crowded")).alias("asked"))
    read = cut(here.join(wanted, list(KEY)).mapInArrow(trimmed(_contexts(unit)), f"gram long, bytes binary, {ROW}, first long, windows long, fresh boolean, crowded boolean"))
    runs, left = _parted(read.where("crowded"), unit, ordered, crowd)
    compare = read.where("NOT crowded").drop("crowded")
    for more in left:
        compare = compare.unionByName(more.drop("crowded"))
    compared = compare.repartition("gram").sortWithinPartitions("gram").mapInArrow(trimmed(_resolve(unit, index)), f"{ROW}, start long, end long")
    first = F.shiftright("pos", 21)
    spans = marks.where("settled").select(*KEY, first.alias("start"), (first + F.col("pos").bitwiseAND((1 << 21) - 1) + unit.length).alias("end"))
    for more in runs:
        spans = spans.unionByName(more)
    return spans.unionByName(compared).groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("__spans"))


def outcome(docs: DataFrame, spans: DataFrame, own: str, row) -> DataFrame:
    """The rows of `keyed` docs with columns `own` that row(text bytes or None, merged runs) gives for each."""
    from pyspark.sql import types as T

    # Rows hold their text; it moves once.
    joined = docs.drop("text").join(spans, list(KEY), "left").select("row", "__spans")
    made = T.StructType.fromDDL(own)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(made)
        for batch in sliced(batches):
            texts, found = batch.column(0).field("text"), batch.column(1).to_pylist()
            rows = [row(t.as_buffer(), merged(f)) for t, f in zip(texts, found, strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)]], ["row", *schema.names])

    out = joined.mapInArrow(trimmed(run), T.StructType([joined.schema["row"], *made.fields]))
    return out.select("row.*", *made.names)


def merged(spans) -> list[tuple[int, int]]:
    """Sorted union of half-open runs; runs that touch become one."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
