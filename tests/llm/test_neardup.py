"""Near-duplicates against brute force, sketches against their expectation."""

import random
import re

import pytest

pytest.importorskip("ledgerloom.llm")
from ledgerloom.llm import neardup, sketches  # noqa: E402

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, size=3, per_cent=85):
    sets = []
    for _, t in rows:
        ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} if len(ws) >= size else {tuple(ws)} if ws else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= per_cent * len(a | b):
                parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    return sorted((d, len(sets[i]), min(groups[root(i)])) for i, (d, _) in enumerate(rows))


def edits(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randint(0, 10**6)}"
    return out


def corpus(seed, hot=150):
    rng = random.Random(seed)
    texts = [None, "", " \n", "one", "One", "two words", "TWO words", "a b c", "É x y z"]
    for _ in range(25):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([6, 20, 60, 200]))]
        for _ in range(rng.randint(1, 5)):
            base = edits(rng, base, rng.randint(0, len(base) // 30 + 1))  # chains of edits
            texts.append(" ".join(base))
    base = [f"h{i}" for i in range(120)]
    texts += [" ".join(edits(rng, base, rng.randint(0, 6))) for _ in range(hot)]
    texts += ["the same text again and again"] * 20
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_exact(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, n string, rep string").repartition(3)
    out = neardup.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_stage_keeps_one_of_each(spark):
    rows = corpus(3, 40)
    df = spark.createDataFrame([(i, t, 1, -i, "c") for i, t in rows], "doc_id long, text string, key int, __id int, component string")
    kept = neardup.one_of_each(df)
    assert kept.columns == df.columns and all(r["__id"] == -r.doc_id for r in kept.collect())
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute(rows, 5, 80)})
    assert neardup.one_of_each(df.limit(0)).count() == 0 and neardup.near_duplicates(df.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "q r s"), (5, "a b c d"), (5, "a b c d"), (5, "other text here"), (6, None)], "doc_id long, text string")
    out = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in neardup.near_duplicates(df).collect())
    assert out == sorted([("None", 2, "None", True), ("None", 1, "None", True), ("5", 2, "None", False), ("5", 2, "None", False), ("5", 1, "5", True), ("6", 0, "6", True)])


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 50)] + [(5000, 4000)]
    out = {r.node: r.component for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)} | {4000: 4000, 5000: 4000}


@pytest.mark.parametrize("limits", [{"QUERIES": 16, "ROWS": 20}, {"QUERY_SHINGLES": 900, "ROW_SHINGLES": 1500}])
def test_blocks_cover_every_pair(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(neardup, name, value)
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()) == brute(rows)


@pytest.mark.parametrize(("size", "per_cent", "n", "moved", "seeds"), [(3, 85, 111, 9, [511, 3241]), (5, 80, 90, 10, [315, 639, 898, 1141])])
def test_a_low_estimate_cuts_no_link(spark, size, per_cent, n, moved, seeds):
    """Pairs exactly at the threshold that share a band, but whose registers estimate them 0.09 and more below it."""
    rows = []
    for seed in seeds:
        words = [f"v{seed}x{i}" for i in range(n + size - 1 + moved)]
        rows += [(2 * seed, " ".join(words[: n + size - 1])), (2 * seed + 1, " ".join(words[moved:]))]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size, per_cent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute(rows, size, per_cent)
    assert {r.component_id for r in out} == {2 * seed for seed in seeds}


def test_blocks_test_all_whatever_the_estimate(monkeypatch):
    import numpy as np

    monkeypatch.setattr(neardup, "joint_estimate", lambda a, b, na, nb: np.zeros(len(a)))
    sets = [np.sort(np.arange(k, k + 100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k in (0, 2)]
    registers = sketches.sketches(sets)
    keys = sketches.band_keys(registers)
    band = int(keys[0][(keys[0] == keys[1]).argmax()])
    rows = [{"band": band, "rep": i, "component": i, "minor": True, "query": q, "n": 100, "registers": registers[i].tobytes(), "set": sets[i].tobytes()} for i in (0, 1) for q in (True, False)]
    assert neardup._cross(rows, 85) == [(0, 1)]


def test_sketches_merge_and_estimate():
    import numpy as np

    rng = np.random.default_rng(3)
    a, b = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (700, 40))
    both = np.unique(np.concatenate([a, b]))
    ra, rb, rc = sketches.sketches([a, b, both])
    assert (np.maximum(ra, rb) == rc).all()
    errors = []
    for share in (0.5, 0.85, 0.95):
        common = rng.integers(0, 2**63, int(2000 * share)).astype(np.uint64)
        xs = [np.unique(np.concatenate([common, rng.integers(0, 2**63, (2000 - len(common)) // 2).astype(np.uint64)])) for _ in range(2)]
        r = sketches.sketches(xs)
        true = len(np.intersect1d(*xs)) / len(np.union1d(*xs))
        errors.append(sketches.joint_estimate(r[:1], r[1:], np.array([float(len(xs[0]))]), np.array([float(len(xs[1]))]))[0] - true)
    assert max(map(abs, errors)) < 0.12
