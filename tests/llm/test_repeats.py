"""Suffix-array and substring dedup against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest

pytest.importorskip("ledgerloom.llm")
from ledgerloom.llm import substrings, suffixes  # noqa: E402
from ledgerloom.llm.repeats import Unit  # noqa: E402

SCHEMA = "doc_id long, text string, n_bytes string, __spans string, __id string, row string"


def brute_bytes(texts, n):
    seen = defaultdict(int)
    raws = [(t or "").encode() for t in texts]
    for r in raws:
        for i in range(len(r) - n + 1):
            seen[r[i : i + n]] += 1
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, n):
    least = {}
    ws = [(t or "").encode().split() for _, t in rows]
    key = [-(1 << 63) if i is None else i for i, _ in rows]
    for k, w in zip(key, ws, strict=True):
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            least[g] = min(least.get(g, k), k)
    out = []
    for k, w in zip(key, ws, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if least[tuple(w[i : i + n])] < k:
                gone[i : i + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, sep=""):
    rng = random.Random(seed)
    words = ["ab", "é", "cde", "f", "gh漢", "xyz", "q"]
    passage = [[rng.choice(words) for _ in range(rng.randint(10, 60))] for _ in range(6)]
    texts = [None, "", "a" * 80, " ".join(["ab"] * 60), "short"]
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = list(rng.choice(passage)) if rng.random() < 0.6 else [rng.choice(words) + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 30))]
            a, b = sorted(rng.choices(range(len(p) + 1), k=2))
            p = p[a:b] if rng.random() < 0.5 else p
            if p and rng.random() < 0.3:
                p[rng.randrange(len(p))] = "EDIT"
            parts += p
        texts.append(rng.choice([" ", "\n"]).join(parts))
    texts += [texts[10], texts[10], texts[12]]
    ids = [*range(len(texts))]
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    return [*rows, rows[9], (None, texts[14])]


@pytest.mark.parametrize(("seed", "crowd", "hot"), [(1, 4096, None), (2, 1, 5), (3, 3, None), (4, 2, 1)])
def test_bytes(spark, seed, crowd, hot):
    rows = corpus(seed)
    unit = Unit("bytes", 40, 10)
    df = spark.createDataFrame([(*r, *["clash"] * 4) for r in rows], SCHEMA).repartition(3)
    out = suffixes.dedup(df, unit, crowd=crowd, hot=hot).selectExpr("doc_id", "text", "row", "n_bytes", "n_removed", "n_spans", "sha2(kept_bytes, 256) AS k").collect()
    want = sorted((str(i), t or "", *b) for (i, t), b in zip(rows, brute_bytes([t for _, t in rows], 40), strict=True))
    assert {r.row for r in out} == {"clash"}
    assert sorted((str(r.doc_id), r.text or "", r.n_bytes, r.n_removed, r.n_spans, r.k) for r in out) == want


@pytest.mark.parametrize(("seed", "crowd", "hot"), [(1, 4096, None), (2, 1, 5), (3, 3, None), (4, 2, 1)])
def test_words(spark, seed, crowd, hot):
    rows = corpus(seed)
    unit = Unit("words", 12, 4)
    df = spark.createDataFrame([(*r, *["clash"] * 4) for r in rows], SCHEMA).repartition(3)
    out = substrings.dedup_words(df, unit, 3, crowd=crowd, hot=hot).selectExpr("doc_id", "text", "n_words", "n_removed", "sha2(kept_text, 256) AS k").collect()
    want = sorted((str(i), t or "", *b) for (i, t), b in zip(rows, brute_words(rows, 12), strict=True))
    assert sorted((str(r.doc_id), r.text or "", r.n_words, r.n_removed, r.k) for r in out) == want


def test_production_parameters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digest(docs).collect())
    assert got == sorted((i, *b) for (i, _), b in zip(rows, brute_bytes([t for _, t in rows], 400), strict=True))
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(docs).collect())
    assert got == sorted((i, *b) for (i, _), b in zip(rows, brute_words(rows, 50), strict=True))


def test_cut_texts_and_empty_tables(spark):
    text = "passage " * 60
    df = spark.createDataFrame([(1, "é" + text + "x", 9), (2, "zé" + text, 9), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in suffixes.without_repeats(df, suffixes.UNIT).collect()}
    assert out[3].text == "clean" and all(len(out[i].text) == out[i].n_chars < 10 for i in (1, 2))
    same = "doc_id long, text string, __spans string, __id string, n_removed string, whole string"
    clash = spark.createDataFrame([(1, "a " + text, *"abcd"), (2, text + " b", *"abcd"), (None, None, *"abcd")], same)
    assert sorted((str(r.doc_id), r.text and r.text.strip(), *r[2:]) for r in suffixes.without_repeats(clash).collect()) == [("1", "a", *"abcd"), ("2", "b", *"abcd"), ("None", None, *"abcd")]
    shared = "m" * 500
    halves = spark.createDataFrame([(1, "\u00e9" + shared, 501), (2, "\u0129" + shared + "z", 502)], "doc_id long, text string, n_chars long")  # their last bytes are equal
    assert {r.doc_id: (r.text, r.n_chars) for r in suffixes.without_repeats(halves, suffixes.UNIT).collect()} == {1: ("", 0), 2: ("z", 1)}
    assert suffixes.dedup(df.limit(0)).count() == 0 and substrings.dedup_words(df.limit(0)).count() == 0


def test_fm_index_counts_and_wavelet_rank():
    import numpy as np

    rng = np.random.default_rng(1)
    text = np.r_[0, rng.integers(1, 6, 300), 0, rng.integers(1, 6, 200), 0]
    owner = np.sort(rng.integers(0, 9, len(text)))
    fm = substrings.FMIndex(text, owner, 6, 4)
    for _ in range(200):
        p = rng.integers(1, 6, 4)
        low, high = np.array([0]), np.array([len(text)])
        for c in p[::-1]:
            low, high = fm.extend(np.array([c]), low, high)
        at = [i for i in range(len(text) - 3) if (text[i : i + 4] == p).all()]
        assert high[0] - low[0] == len(at)
        if at:
            assert fm.owners.least(low, high)[0] == min(owner[at])
        for own in (0, 4, 9):
            want = next(k for k in range(4, -1, -1) if k < 4 and (k == 0 or sum((text[i : i + k] == p[4 - k :]).all() for i in range(len(text) - k + 1)) > 1) or k == 4 and len(at) > 1 and min(owner[at]) < own)
            assert fm.statistics(p[None], np.array([own]))[0] == want


@pytest.mark.parametrize(("q", "target", "parts"), [(2, 8, 3), (1, 5, 1), (3, 12, 8), (4, 4, 2)])
def test_refinement_sorts_to_its_depth(q, target, parts):
    import numpy as np

    rng = np.random.default_rng(q)
    strings = [rng.integers(0, 2, rng.integers(0, 60)) for _ in range(20)]
    keys, grams = [], []
    for s in strings:
        for i in range(len(s)):
            grams.append(int("".join(map(str, s[i : i + q])), 2) if i + q <= len(s) else -1)
            keys.append(tuple(int("".join(map(str, s[j : j + q])), 2) if j + q <= len(s) else -1 for j in range(i, i + target, q)))
        grams.append(-1)
        keys.append(())
    sa = suffixes.order(np.array(grams + [-1] * target), q, target, parts)
    assert sorted(sa.tolist()) == [i for i, g in enumerate(grams) if g >= 0]
    found = [keys[i] for i in sa.tolist()]
    short = lambda k: k[: k.index(-1)] if -1 in k else k
    assert list(map(short, found)) == sorted(map(short, found))


def test_texts_longer_than_a_part(spark, monkeypatch):
    from ledgerloom.llm import repeats

    monkeypatch.setattr(repeats, "PART", 64)
    rows = corpus(7)
    for unit, module in ((Unit("bytes", 40, 10), suffixes), (Unit("words", 12, 4), substrings)):
        h, seen = repeats.Hasher(), defaultdict(set)
        for _, t in rows:
            symbols, _ = h.symbols((t or "").encode(), unit.kind)
            found = repeats.stretches(h, symbols, unit)
            covered = [i for a, b in zip(found[3].tolist(), found[4].tolist(), strict=True) for i in range(a, b + 1)]
            assert covered == list(range(max(len(symbols) - unit.length + 1, 0))) and module
            for g, a, b in zip(found[0].tolist(), found[3].tolist(), found[4].tolist(), strict=True):
                for i in range(a, b + 1):
                    seen[symbols[i : i + unit.length].tobytes()].add(g)
        assert all(len(v) == 1 for v in seen.values())  # equal windows meet under one gram, wherever a part ends


def test_null_ids_with_equal_short_hashes_stay_apart(spark):
    """Rows without an id are told apart by 128 bits of their texts, others by their id and 64."""
    from ledgerloom.llm import repeats

    df = spark.range(300_000).selectExpr("cast(null as long) AS doc_id", "concat('t', id) AS text")
    keys = repeats.keyed(df)
    assert keys.selectExpr("hash(text, length(text)) AS h").distinct().count() < 300_000
    assert keys.select(*repeats.KEY).distinct().count() == 300_000
