"""SetSketch registers: truncated, exponentially spaced minima of a set's hashes."""

from __future__ import annotations

import math

from .base import mix, randoms, span_hashes, word_spans

#: Registers, registers of a band, base and rate of the spacing; registers are bytes.
REGISTERS, BAND, BASE, RATE = 192, 6, 1.08, 20.0


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased."""

    def __init__(self, size: int = 3):
        import numpy as np

        self.size = size
        self.bytes, self.place = randoms(256, 3), randoms(64, 7)
        for c in range(ord("A"), ord("Z") + 1):
            self.bytes[c] = self.bytes[c + 32]
        self.weights = [np.uint64(int(x) | 1) for x in randoms(size, 13)]

    def __call__(self, raw):
        import numpy as np

        data = np.frombuffer(raw, np.uint8)
        words, self.place = span_hashes(data, *word_spans(data), self.bytes, self.place)
        n = len(words)
        if not n:
            return words
        if n < self.size:
            return mix(np.array([sum((int(w) * int(m) for w, m in zip(words, self.weights, strict=False)), n) & ((1 << 64) - 1)], np.uint64))
        total = words[: n - self.size + 1] * self.weights[0]
        for k in range(1, self.size):
            total = total + words[k : n - self.size + 1 + k] * self.weights[k]
        return np.unique(mix(total))


def sketches(sets: list):
    """uint8 registers (sets, REGISTERS) of non-empty arrays of hashes.

    Each hash is a Poisson process of rate RATE in every register: points come in rising order with exponential gaps, each in
    a register drawn at random. Points beyond a bound that few registers need are not made, so the work goes with the set's
    size and not with size times registers; sets with an open register are done again with a larger bound."""
    import numpy as np

    m = REGISTERS
    sizes = np.array([len(s) for s in sets])
    best = np.full((len(sets), m), np.inf)
    todo, slack = np.arange(len(sets)), math.log(m) + 3.0
    while len(todo):
        h = np.concatenate([sets[i] for i in todo])
        row = np.repeat(todo, sizes[todo])
        bound = (slack / RATE / np.maximum(sizes, 1))[row]
        x, state = np.zeros(len(h)), h.copy()
        while len(row):
            state = state + np.uint64(0x9E3779B97F4A7C15)
            draw = mix(state)
            x = x - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / (RATE * m)
            live = x <= bound
            row, x, state, bound = row[live], x[live], state[live], bound[live]
            register = (mix(draw[live] ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(m)).astype(np.int64)
            np.minimum.at(best.reshape(-1), row * m + register, x)
        todo = todo[np.isinf(best[todo]).any(axis=1)]
        slack *= 2
    return np.clip(np.floor(1 - np.log(best) / math.log(BASE)), 0, 255).astype(np.uint8)


def band_keys(registers):
    """uint64 (sets, bands): a hash of each band's registers and number."""
    import numpy as np

    bands = registers.shape[1] // BAND
    parts = registers[:, : bands * BAND].reshape(len(registers), bands, BAND).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(BAND):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k] + np.uint64(1))
    return key


def joint_estimate(a, b, na, nb):
    """Most likely Jaccard similarity, on a grid, from how many registers of each row of a are above, equal to and below b's, given the sets' sizes.

    With shares u, v of the union outside the other set, a register of a is above b's with probability p(u) and below with
    p(v), p(x) = -log_b(1 - x (b - 1) / b)."""
    import numpy as np

    m = a.shape[1]
    above, below = (a > b).sum(1), (a < b).sum(1)
    ratio = na / (na + nb)
    best, value = np.full(len(a), -np.inf), np.zeros(len(a))
    p = lambda x: np.clip(-np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE), 1e-12, 1)
    for j in np.linspace(0.0, 1.0, 101):
        u, v = np.clip(ratio * (1 + j) - j, 0, 1), np.clip((1 - ratio) * (1 + j) - j, 0, 1)
        up, down = p(u), p(v)
        score = above * np.log(up) + below * np.log(down) + (m - above - below) * np.log(np.clip(1 - up - down, 1e-12, 1))
        better = score > best
        best, value = np.where(better, score, best), np.where(better, j, value)
    return value
