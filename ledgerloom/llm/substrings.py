"""Substring dedup: an FM-index per shard, backward search over a wavelet tree, intervals above the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import CROWD, Hasher, Unit, keyed, outcome, repeated

LENGTH = 50
UNIT = Unit("words", LENGTH, 16)
#: Words of a symbol of the index; it divides the window.
STRIDE = 10
#: Windows that are streamed against an index at once.
STREAM = 1 << 15


class WaveletTree:
    """Levelwise bit vectors with block counts: rank of a symbol before a place in as many steps as symbols have bits."""

    def __init__(self, values, symbols: int):
        import numpy as np

        self.bits = max(1, int(symbols - 1).bit_length())
        self.levels, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = ((values >> level) & 1).astype(np.uint8)
            packed = np.zeros((len(bit) // 64 + 1) * 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(np.uint64)
            counts = np.r_[0, np.cumsum(np.bitwise_count(words).astype(np.int64))]
            self.levels.append((words, counts))
            self.zeros.append(len(bit) - int(counts[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def _ones(self, level: int, at):
        import numpy as np

        words, counts = self.levels[level]
        block, rest = at >> 6, (at & 63).astype(np.uint64)
        return counts[block] + np.bitwise_count(words[block] & ((np.uint64(1) << rest) - np.uint64(1))).astype(np.int64)

    def rank(self, symbol, at):
        """How often each symbol occurs before each place."""
        import numpy as np

        low = np.zeros_like(at)
        for k in range(self.bits):
            bit = (symbol >> (self.bits - 1 - k)) & 1
            a, b = self._ones(k, low), self._ones(k, at)
            low = np.where(bit == 1, self.zeros[k] + a, low - a)
            at = np.where(bit == 1, self.zeros[k] + b, at - b)
        return at - low

    def least(self, low, high):
        """The least value in each range [low, high), none of them empty: zeros are taken at every level where the range has one."""
        import numpy as np

        low, high, value = low.copy(), high.copy(), np.zeros_like(low)
        for k in range(self.bits):
            a, b = self._ones(k, low), self._ones(k, high)
            ones = high - low == b - a
            value = value * 2 + ones
            low, high = np.where(ones, self.zeros[k] + a, low - a), np.where(ones, self.zeros[k] + b, high - b)
        return value


class FMIndex:
    """Over a text of symbols 1.. with 0 between strings, each place owned by a document.

    Its suffixes are ordered by their first `depth` symbols, which is all that patterns of up to `depth` symbols need. What is
    kept are two wavelet trees, of the symbols before the suffixes and of the documents that own them, in packed bits: neither
    the text nor the suffix array stays."""

    def __init__(self, text, owner, symbols: int, depth: int):
        import numpy as np

        n = len(text)
        padded = np.r_[text, np.zeros(depth, text.dtype)]
        sa = np.lexsort([padded[d : d + n] for d in range(depth - 1, -1, -1)])
        self.size, self.depth = n, depth
        self.tree, self.owners = WaveletTree(text[sa - 1], symbols), WaveletTree(owner[sa], int(owner.max()) + 1)
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=symbols))]

    def extend(self, symbol, low, high):
        """Backward search by one symbol."""
        return self.before[symbol] + self.tree.rank(symbol, low), self.before[symbol] + self.tree.rank(symbol, high)

    def statistics(self, pattern, own):
        """Matching statistics of streamed windows: how many symbols, counted from its end, each window shares with a document before its `own`.

        pattern: (windows, depth) symbols. A window whose interval holds only itself drops out; owners are looked up where an
        interval holds more. The count ends at `depth`, as whole windows are what is reported."""
        import numpy as np

        length = np.zeros(len(pattern), np.int64)
        live = np.arange(len(pattern))
        low, high = np.zeros(len(pattern), np.int64), np.full(len(pattern), self.size, np.int64)
        for k in range(self.depth - 1, -1, -1):
            low, high = self.extend(pattern[live, k], low, high)
            more = high - low > 1
            live, low, high = live[more], low[more], high[more]
            if k == 0 and len(live):
                before = self.owners.least(low, high) < own[live]
                live, low, high = live[before], low[before], high[before]
            length[live] += 1
        return length


def index(h: Hasher, rows: list[dict], unit: Unit = UNIT, stride: int = STRIDE) -> list[tuple[int, int, int]]:
    """Runs of windows of each row that also occur in a row of a smaller id.

    A symbol stands for `stride` words. Every string gives `stride` sequences, one a phase, so each window is a pattern of
    length / stride symbols. Documents are numbered by rising id and their windows streamed against the shard's index; runs
    of windows whose matching statistic reaches the threshold are reported."""
    import numpy as np

    flat, _ = h.symbols(b"\n".join(r["bytes"] for r in rows), "words")
    windows = np.array([r["windows"] for r in rows])
    size = windows + unit.length - 1
    start = np.r_[0, np.cumsum(size)[:-1]]
    prefix = h.prefix(flat, 0)
    steps = unit.length // stride
    document = np.unique(np.array([r["__id"] for r in rows], np.int64), return_inverse=True)[1]
    # Symbols of the places with `stride` words left in their string, laid out by string and phase.
    count = size - stride + 1
    row = np.repeat(np.arange(len(rows)), count)
    place = np.arange(int(count.sum())) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
    symbol = np.unique(h.stretch(prefix, start[row] + place, start[row] + place + stride, 0), return_inverse=True)[1] + 1
    by = np.lexsort((place, place % stride, row))
    gap = np.r_[True, (row[by][1:] != row[by][:-1]) | (place[by][1:] % stride != place[by][:-1] % stride)]
    at = np.arange(len(by)) + np.cumsum(gap)  # a 0 before each sequence
    text = np.zeros(int(at[-1]) + 2, np.int64)
    text[at] = symbol[by]
    owner = np.zeros(len(text), np.int64)
    owner[at] = document[row[by]]
    fm = FMIndex(text, owner, int(symbol.max()) + 1, steps)

    first = np.r_[0, np.cumsum(count)[:-1]]
    query = np.arange(int(windows.sum())) - np.repeat(np.r_[0, np.cumsum(windows)[:-1]], windows)
    query_row = np.repeat(np.arange(len(rows)), windows)
    out = []
    for lo in range(0, len(query), STREAM):
        r, q = query_row[lo : lo + STREAM], query[lo : lo + STREAM]
        pattern = symbol[(first[r] + q)[:, None] + np.arange(steps) * stride]
        hit = fm.statistics(pattern, document[r]) == steps
        for k, w in zip(r[hit].tolist(), q[hit].tolist(), strict=True):
            if out and out[-1][0] == k and out[-1][2] == w - 1:
                out[-1] = (k, out[-1][1], w)
            else:
                out.append((k, w, w))
    return out


def dedup_words(docs: DataFrame, unit: Unit = UNIT, stride: int = STRIDE, crowd: int = CROWD, hot: int | None = None) -> DataFrame:
    """docs plus kept_text, n_words, n_removed.

    Every word under a window of `unit.length` words whose sequence also starts in a document of a smaller id is removed,
    judged on the input. Null texts have no words; a null id counts as the least; rows of equal id never cut each other;
    columns of those three names in docs are replaced, all others come back whatever their names. Long texts are read whole;
    an empty table gives an empty one."""
    docs = keyed(docs.drop("kept_text", "n_words", "n_removed"))
    spans = repeated(docs, unit, lambda h, rows: index(h, rows, unit, stride), ordered=True, crowd=crowd, hot=hot)

    def row(buffer, runs):
        ws = buffer.to_pybytes().split() if buffer else []
        n = len(ws)
        for a, b in reversed(runs):
            del ws[a:b]
        return b" ".join(ws).decode(), n, n - len(ws)

    return outcome(docs, spans, "kept_text string, n_words long, n_removed long", row)


def digest(docs: DataFrame) -> DataFrame:
    return dedup_words(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
