"""Suffix-array dedup: windows that occur twice are cut, found by bucket-pointer refinement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import word_spans
from .repeats import CROWD, Hasher, Unit, keyed, outcome, repeated

LENGTH = 400
UNIT = Unit("bytes", LENGTH, 100)
#: For passages rather than bytes: words, however they are spaced.
PASSAGE = Unit("words", 50, 10)


def order(grams, q: int, target: int, parts: int = 8):
    """Places sorted by their first `target` symbols, by bucket-pointer refinement.

    grams: the number of the q-gram that starts at each place, -1 where fewer than q symbols of its string are left and at a
    place between strings. A place's bucket pointer is the first slot of its bucket. Buckets are refined from left to right, in `parts` of about equal size:
    their places are sorted on the pointers of the places `depth` further on, pointers are written back at once, and what is
    still alike goes on at the next depth. So later rounds and later buckets look at pointers that are refined already and
    part sooner; a refined pointer lies within its old bucket's slots, so the order by q-grams at 0, q, 2q, .. holds."""
    import numpy as np

    n = len(grams)
    places = np.flatnonzero(grams >= 0)
    sa = places[np.argsort(grams[places], kind="stable")]
    first = np.flatnonzero(np.r_[True, grams[sa[1:]] != grams[sa[:-1]]]) if len(sa) else places
    size = np.diff(np.r_[first, len(sa)])
    pointer = np.full(n + target, -1, np.int64)
    pointer[sa] = np.repeat(first, size)
    wide = np.flatnonzero(np.repeat(size > 1, size))
    # A part ends with a bucket.
    ends = [0, *[int(np.searchsorted(wide, pointer[sa[wide[len(wide) * k // parts]]])) for k in range(1, parts)], len(wide)] if len(wide) else [0]
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        slots, depth = wide[lo:hi], q
        while depth < target and len(slots):
            members = sa[slots]
            key = pointer[members] * (n + 1) + pointer[members + depth] + 1
            by = np.argsort(key)
            members, key = members[by], key[by]
            sa[slots] = members
            new = np.r_[True, key[1:] != key[:-1]]
            group = np.cumsum(new) - 1
            pointer[members] = slots[new][group]
            slots = slots[np.bincount(group)[group] > 1]
            depth += q
    return sa


def index(h: Hasher, rows: list[dict], unit: Unit = UNIT) -> list[tuple[int, int, int]]:
    """Runs of windows of each fresh row that occur in another place of the shard: neighbours in the suffix order with equal windows."""
    import numpy as np

    # The q-grams of a window lie side by side.
    q = next(k for k in range(unit.gram, 0, -1) if unit.length % k == 0)
    symbols, _ = h.symbols((b"" if unit.kind == "bytes" else b"\n").join(r["bytes"] for r in rows), unit.kind)
    windows = np.array([r["windows"] for r in rows])
    size = windows + unit.length - 1
    start = np.r_[0, np.cumsum(size)[:-1]]
    places = np.arange(len(symbols) - q + 1)
    row = np.searchsorted(start, places, "right") - 1
    whole = (start + size)[row] - places >= q
    inside, row = places[whole], row[whole]
    # A place after each string keeps suffixes from running into the next.
    grams = np.full(len(symbols) + len(rows) + unit.length, -1, np.int64)
    grams[inside + row] = np.unique(h.stretch(h.prefix(symbols, 0), inside, inside + q, 0), return_inverse=True)[1]
    sa = order(grams, q, unit.length)
    a, b = sa[:-1], sa[1:]
    alike = np.ones(len(a), bool)
    for k in range(0, unit.length, q):
        alike &= (grams[a + k] == grams[b + k]) & (grams[a + k] >= 0)
    twice = np.zeros(len(grams), bool)
    start += np.arange(len(rows))
    twice[a[alike]] = twice[b[alike]] = True
    out = []
    for r, row in enumerate(rows):
        if row["fresh"]:
            hit = np.flatnonzero(np.diff(np.r_[False, twice[start[r] : start[r] + row["windows"]], False].astype(np.int8)))
            out += [(r, int(a), int(b) - 1) for a, b in zip(hit[::2], hit[1::2], strict=True)]
    return out


def dedup(docs: DataFrame, unit: Unit = UNIT, as_text: bool = False, crowd: int = CROWD, hot: int | None = None) -> DataFrame:
    """docs plus kept_bytes, n_bytes, n_removed, n_spans. kept_bytes is binary, or text without the odd bytes of cut characters.

    Every byte under a window of `unit.length` bytes that also starts elsewhere in the table is removed, judged on the input.
    With words as the unit, all from the first word of a run of such windows up to the next word that stays goes. Null texts
    are empty, texts under that length are untouched; copies of a row remove each other's text; columns of those four names in
    docs are replaced, all others come back whatever their names. Long texts are read whole; an empty table gives an empty one."""
    docs = keyed(docs.drop("kept_bytes", "n_bytes", "n_removed", "n_spans"))
    spans = repeated(docs, unit, lambda h, rows: index(h, rows, unit), ordered=False, crowd=crowd, hot=hot)

    def row(buffer, runs):
        import numpy as np

        raw = buffer.to_pybytes() if buffer else b""
        if runs and unit.kind == "words":
            starts, ends = word_spans(np.frombuffer(raw, np.uint8))
            runs = [(int(starts[a]), int(starts[b] if b < len(starts) else ends[-1])) for a, b in runs]
        edges = [0, *[x for run in runs for x in run], len(raw)]
        kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        return kept.decode("utf-8", "ignore") if as_text else kept, len(raw), len(raw) - len(kept), len(runs)

    return outcome(docs, spans, f"kept_bytes {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long", row)


def digest(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, unit: Unit = PASSAGE) -> DataFrame:
    """docs with repeated passages cut from text, every occurrence, and n_chars set anew. A cut inside a character drops what is left of it.

    Works on a struct of each row, so columns of any name pass; null texts stay null."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = dedup(docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("whole")), unit, as_text=True)
    old = {c: F.col("whole")[f"c{i}"] for i, c in enumerate(others)} | {"doc_id": F.col("doc_id")}
    touched = F.col("n_removed") > 0
    text = F.when(touched, F.col("kept_bytes")).otherwise(F.col("text"))
    new = old | {"text": text}
    if "n_chars" in old:
        new["n_chars"] = F.when(touched, F.length(text).cast("long")).otherwise(old["n_chars"])
    return out.select(*[new[c].alias(c) for c in docs.columns])
