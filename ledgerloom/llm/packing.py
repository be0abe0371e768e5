"""Packing of tokenised documents into near-equal windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .base import mix, per_process, randoms
from .tokens import byte_alphabet

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Code points of a chunk, and the first code point that the class table leaves to the tokenizer itself.
CHUNK, TABLE = 1 << 17, 0x2100


def split_long(text: str, size: int | None = None) -> list[str]:
    """Cut before single blanks between non-blanks, where a pre-token starts on either side of any cut."""
    parts, at, size = [], 0, size or CHUNK
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m:
            break
        parts.append(text[at : m.start() + 1])
        at = m.start() + 1
    return [*parts, text[at:]]


_SAFE = re.compile(r"\S(?= \S)")


class ByteBPE:
    """Ids of many texts at once: pre-tokens are found and hashed in bulk, and only new ones go to the tokenizer.

    Texts with code points from TABLE on, or with the string of a special token, go to the tokenizer, in chunks if they are long."""

    def __init__(self, path: str, memo: int = 600_000):
        import unicodedata

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_file(path), memo
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([f"[^\\x00-{chr(TABLE - 1)}]", *map(re.escape, special)]))
        kinds = np.zeros(TABLE + 1, np.uint8)
        for c in range(TABLE):
            k = unicodedata.category(chr(c))[0]
            kinds[c] = 1 if k == "L" else 2 if k == "N" else 3 if chr(c).isspace() and not 0x1C <= c <= 0x1F else 0
        kinds[TABLE] = 4
        self.kinds, self.place = kinds, randoms(1024, 11)
        self.letters = {b: c for c, b in byte_alphabet().items()}
        self.forget()

    def forget(self) -> None:
        from array import array

        self.slots, self.ids, self.offset, self.size = {}, array("I"), array("q"), array("q")

    def starts(self, cps):
        """Where pre-tokens start; cps end with the mark that also stands between texts."""
        import numpy as np

        kind = self.kinds[np.minimum(cps, TABLE)]
        start = np.ones(len(cps), bool)
        start[1:] = kind[1:] != kind[:-1]
        blank = kind == 3
        # The last white space before other text is a token of its own, or, if a blank, that token's first character.
        last = np.zeros(len(cps), bool)
        last[:-1] = blank[:-1] & (kind[1:] != 3) & (kind[1:] != 4)
        start |= last
        start[1:] &= ~(last[:-1] & (cps[:-1] == 32))
        mark = np.flatnonzero((cps == 39) & start)
        for i in mark[mark + 1 < len(cps)]:
            a, b = int(cps[i + 1]), int(cps[i + 2]) if i + 2 < len(cps) else 0
            n = 2 if a in (115, 116, 109, 100) else 3 if (a, b) in ((114, 101), (118, 101), (108, 108)) else 0
            if n:
                start[i + 1 : i + n] = False
                if i + n < len(cps) and kind[i + n] == 1:
                    start[i + n] = True
        return start | (kind == 4)

    def encode(self, texts: list[str]) -> list:
        """uint32 arrays, one a text."""
        import numpy as np

        out: list = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if self.odd.search(t):
                out[i] = np.concatenate([np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, np.uint32) for p in split_long(t)])
            else:
                plain.append(i)
        at = 0
        while at < len(plain):
            group, n = [], 0
            while at < len(plain) and (not group or n + len(texts[plain[at]]) < CHUNK):
                group.append(plain[at])
                n += len(texts[plain[at]])
                at += 1
            if n > 2 * CHUNK:
                out[group[0]] = np.concatenate([self._bulk([p])[0] for p in split_long(texts[group[0]])])
            else:
                for i, ids in zip(group, self._bulk([texts[i] for i in group]), strict=True):
                    out[i] = ids
        return out

    def _bulk(self, texts: list[str]) -> list:
        import numpy as np

        tokenize = self.tokenizer.model.tokenize
        joined = "\ue000".join(texts) + "\ue000"
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        start = np.flatnonzero(self.starts(cps))
        size = np.diff(np.append(start, len(cps)))
        if (longest := int(size.max())) > len(self.place):
            self.place = randoms(longest, 11)
        place = np.arange(len(cps), dtype=np.int32) - np.repeat(start.astype(np.int32), size)
        value = self.place[place]
        value *= cps + np.uint32(1)
        h = mix(np.add.reduceat(value, start) ^ mix(size.astype(np.uint64))).tolist()
        if len(self.slots) > self.memo or len(self.ids) > 16 * self.memo:
            self.forget()
        get = self.slots.get
        slot = np.array([get(k, -1) for k in h], np.int64)
        for i in np.flatnonzero(slot < 0).tolist():
            if (known := get(h[i], -1)) < 0:
                piece = joined[start[i] : start[i] + size[i]]
                known = self._add(h[i], [] if piece == "\ue000" else [t.id for t in tokenize(piece.encode().decode("latin-1").translate(self.letters))])
            slot[i] = known
        known, offset, size = (np.frombuffer(x, d) for x, d in ((self.ids, np.uint32), (self.offset, np.int64), (self.size, np.int64)))
        n = size[slot]
        end = np.cumsum(n)
        ids = known[np.repeat(offset[slot] - (end - n), n) + np.arange(int(end[-1]))]
        return np.split(ids, end[np.flatnonzero(cps[start] == 0xE000)])[: len(texts)]

    def _add(self, key: int, ids: list[int]) -> int:
        self.slots[key] = k = len(self.offset)
        self.offset.append(len(self.ids))
        self.size.append(len(ids))
        self.ids.extend(ids)
        return k


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp in k ways: the two partial partitions of the widest spread are joined, largest part to smallest, until one is left."""
    import heapq

    import numpy as np

    groups: list[list[int]] = [[i] for i in range(len(sizes))]
    heap = []
    for i, x in enumerate(sizes):
        sums, ids = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], ids[0] = x, i
        heap.append((-x, i, sums, ids))
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a, ga = heapq.heappop(heap)
        _, _, b, gb = heapq.heappop(heap)
        sums, gb = a + b[::-1], gb[::-1]
        for x, y in zip(ga[(both := (ga >= 0) & (gb >= 0))].tolist(), gb[both].tolist(), strict=True):
            groups[x] += groups[y]
        ids = np.where(ga >= 0, ga, gb)
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), tie, sums, ids[order]))
        tie += 1
    return [groups[g] for g in heap[0][3].tolist() if g >= 0]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most `capacity`; their number rises from the least possible until all fit."""
    if not sizes:
        return []
    k = -(-sum(sizes) // capacity)
    while True:
        found = difference(sizes, k)
        if all(sum(sizes[i] for i in g) <= capacity for g in found):
            return found
        k += max(1, k // 256)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, piece: int = 256, block: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of every row of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Whole windows of a document are sequences by themselves. What is left is cut into pieces of at most `piece` ids, and
    blocks of `block` such pieces, as they come in a partition, are dealt to near-equal windows. A partition needs no other
    one: nothing is shuffled, a task holds one block, and a retry gives the same ids. Null and empty texts are one end id;
    repeated rows are packed as often as they come; null ids stay null."""

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        bpe, task = per_process(("bpe", vocabulary), lambda: ByteBPE(vocabulary)), TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 40
        done: list[tuple] = []
        waiting: list[tuple] = []

        def table():
            cols = list(zip(*done, strict=True)) or [()] * 7
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *[pa.array(c, pa.int64()) for c in cols[1:]]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        def flush():
            nonlocal sequence
            for window in windows([p[2] for p in waiting], capacity):
                at = 0
                for i in sorted(window):
                    done.append((*waiting[i], sequence, at))
                    at += waiting[i][2]
                sequence += 1
            waiting.clear()

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            doc_ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            step = 256
            for lo in range(0, len(texts), step):
                for doc, ids in zip(doc_ids[lo : lo + step], bpe.encode(texts[lo : lo + step]), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    n, raw, at = len(ids), memoryview(ids).cast("B"), 0
                    while at < n:
                        size = capacity if n - at >= capacity else min(piece, n - at)
                        row = (doc, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)]), n)
                        if size == capacity:
                            done.append((*row, sequence, 0))
                            sequence += 1
                        else:
                            waiting.append(row)
                        at += size
                    if len(waiting) >= block:
                        flush()
                if len(done) > 20_000:
                    yield table()
        flush()
        if done:
            yield table()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {SCHEMA}")
