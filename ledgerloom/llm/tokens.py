"""Token counts by a linear longest-match automaton: no pieces are built.

The vocabulary holds word-initial pieces and continuation pieces. A trie over both, with failure links and the number of
pieces that following a link completes, counts the greedy longest-match pieces of a word in one pass over its bytes."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

from .base import per_process


#: Bytes of a word that is worth remembering.
LONG = 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_pieces(path: str) -> tuple[set[bytes], set[bytes]]:
    """Initial and continuation pieces out of a byte-level vocabulary file: pieces with a leading blank start words, and so may every single byte."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    back = byte_alphabet()
    raw = [bytes(back[c] for c in piece) for piece in vocabulary if all(c in back for c in piece)]
    initial = {p[1:] for p in raw if p[:1] == b" " and len(p) > 1} | {bytes([b]) for b in range(256)}
    return initial, {p for p in raw if p}


class Automaton:
    """Counts greedy pieces of words in linear time; `count` gives None where the greedy match gets stuck."""

    def __init__(self, initial: Iterable[bytes], continuation: Iterable[bytes]):
        self.children: list[dict[int, int]] = [{}, {}]  # 0: start of a word, 1: after a piece
        accepts = [False, False]
        for root, pieces in ((0, initial), (1, continuation)):
            for piece in pieces:
                node = root
                for b in piece:
                    nxt = self.children[node].get(b)
                    if nxt is None:
                        nxt = self.children[node][b] = len(self.children)
                        self.children.append({})
                        accepts.append(False)
                    node = nxt
                accepts[node] = node > 1
        n = len(self.children)
        self.fail, self.popped = [-1] * n, [0] * n
        queue = [0, 1]
        for node in queue:
            for b, child in self.children[node].items():
                if accepts[child]:
                    self.fail[child], self.popped[child] = 1, 1
                else:
                    z, popped = self.fail[node], self.popped[node]
                    while z >= 0 and b not in self.children[z]:
                        popped += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[child], self.popped[child] = self.children[z][b], popped
                queue.append(child)

    def count(self, word: bytes) -> int | None:
        node, pieces = 0, 0
        children, fail, popped = self.children, self.fail, self.popped
        for b in word:
            while (nxt := children[node].get(b)) is None:
                if fail[node] < 0:
                    return None
                pieces += popped[node]
                node = fail[node]
            node = nxt
        while node > 1:
            if fail[node] < 0:
                return None
            pieces += popped[node]
            node = fail[node]
        return pieces


class _Memo(dict):
    """Counts of the words met so far, at most `size` of them, of at most LONG bytes each."""

    def __init__(self, automaton: Automaton, size: int):
        super().__init__()
        self.automaton, self.size = automaton, size

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word)
        value = -1 if n is None else n
        if len(word) <= LONG:
            if len(self) >= self.size:
                self.clear()
            self[word] = value
        return value


def token_counts(docs: DataFrame, vocabulary: str, memo: int = 400_000) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of every row of docs(doc_id, text).

    A word (`[^\\x20\\x09-\\x0D]+`, as UTF-8) that the greedy match cannot cut counts as one token and as unknown. Null and
    empty texts give zeros; repeated rows and null ids stay as they are. No shuffle: one pass, a memo of bounded size."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen = per_process(("pieces", vocabulary, memo), lambda: _Memo(Automaton(*byte_level_pieces(vocabulary)), memo))
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                raw = text.as_buffer()
                counts = [seen[w] for w in (raw.to_pybytes() if raw else b"").split()]
                unknown = counts.count(-1)
                rows.append((len(counts), sum(counts) + 2 * unknown, unknown))
            a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_tokens long, n_unknown long")
