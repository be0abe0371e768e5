"""What several operators share: lineage cuts, the word pattern, vectorised hashing of byte buffers."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what separates words.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the session's checkpoint folder and read on from there; a folder of its own only where none is set and the session is local."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set; executors need a shared folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loom-ckpt-"))
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, one for each of names."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def words(text: Column) -> Column:
    """Words of a text, none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def small(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """df, marked for broadcast if it has at most `limit` rows; otherwise Spark joins it by a shuffle. df is read twice, so it should be cut or cheap."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def per_process(key: tuple, make):
    """make() once in a Python worker, kept for the tasks that it runs later."""
    import sys
    import types

    kept = sys.modules.setdefault("_loom_process", types.ModuleType("_loom_process")).__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def sliced(batches, rows: int = 512):
    """Parts of record batches, so that what a task makes of one stays small."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def trimmed(run):
    """run, and then freed memory back to the system: worker processes outlive their tasks, and several share an executor."""
    def task(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return task


def mix(h):
    """Finaliser of 64-bit hashes (uint64 arrays)."""
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def randoms(n: int, seed: int):
    """n fixed 64-bit numbers."""
    import numpy as np

    return mix((np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ mix(np.full(1, seed, np.uint64)))


def space_table():
    import numpy as np

    t = np.zeros(256, bool)
    t[[ord(c) for c in SPACES]] = True
    return t


def word_spans(data):
    """Starts and ends (exclusive) of the words of a uint8 buffer."""
    import numpy as np

    word = np.empty(len(data) + 2, bool)
    word[0] = word[-1] = False
    np.logical_not(space_table()[data], out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def span_hashes(data, starts, ends, table, multipliers):
    """64-bit hashes of the byte spans: sum of table[byte] * multiplier[place in the span], mixed with the length. multipliers grow as needed and are returned."""
    import numpy as np

    if not len(starts):
        return np.zeros(0, np.uint64), multipliers
    sizes = ends - starts
    if (longest := int(sizes.max())) > len(multipliers):
        multipliers = randoms(longest, 7)
    total = int(sizes.sum())
    first = np.zeros(len(sizes), np.int64)
    np.cumsum(sizes[:-1], out=first[1:])
    place = np.arange(total, dtype=np.int64) - np.repeat(first, sizes)
    value = table[data[place + np.repeat(starts, sizes)]] * multipliers[place]
    acc = np.add.reduceat(value, first)
    return mix(acc ^ mix(sizes.astype(np.uint64))), multipliers
