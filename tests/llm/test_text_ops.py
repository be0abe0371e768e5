"""Token counts, packing, chat formatting, quality rules and fingerprints against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("ledgerloom.llm")
P = pytest.importorskip("public_tokenizers")
from ledgerloom.llm import chat, mixing, packing, quality, tokens, winnow  # noqa: E402

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeé ñ漢")[:1] for _ in range(rng.randint(1, 9))).replace(" ", "") or "q" for _ in range(60)]
    texts = [None, "", " \n\t ", "one", "two words", "x" * 3000, "a\x0bb\x0cc\r\nd e\u0085f", "<|endoftext|> & 'tis don't we'll ''s"]
    for _ in range(40):
        n = rng.choice([3, 9, 12, 40, 300])
        texts.append("".join(rng.choice(vocab) + rng.choice([" ", "  ", "\n", ". "]) for _ in range(n)))
    texts += [texts[-1], texts[-1], texts[-2] + "\n" + texts[-2], "# $ % | <a> " * 30, " ".join(["same"] * 50), "line one two\n" * 12]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s1", None]), len(t or "")) for i, t in enumerate(texts)]
    return [*rows, (None, "no id here", "en", "s0", 3), rows[10]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


def test_token_counts_are_greedy(docs):
    initial, more = tokens.byte_level_pieces(P.path("byte_bpe_50k.json"))

    def greedy(w):
        n, at = 0, 0
        while at < len(w):
            pieces = initial if at == 0 else more
            end = next(e for e in range(len(w), at, -1) if w[at:e] in pieces)
            n, at = n + 1, end
        return n

    got = Counter((r.doc_id, r.n_words, r.n_tokens, r.n_unknown) for r in tokens.token_counts(docs, P.path("byte_bpe_50k.json")).collect())
    want = Counter((i, len(ws), sum(map(greedy, ws)), 0) for i, t, *_ in corpus() for ws in [(t or "").encode().split()])
    assert got == want


def test_automaton_with_unknowns():
    rng = random.Random(5)
    for _ in range(300):
        initial = {bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 4))) for _ in range(4)}
        more = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 4))) for _ in range(4)}
        a = tokens.Automaton(initial, more)
        for _ in range(20):
            w = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 9)))
            n, at = 0, 0
            while n is not None and at < len(w):
                end = next((e for e in range(len(w), at, -1) if w[at:e] in (initial if at == 0 else more)), None)
                n, at = (None, at) if end is None else (n + 1, end)
            assert a.count(w) == n, (initial, more, w)


def test_packing_covers_every_id_once(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text, *_ in corpus():
        want[i, tuple([*t.encode(text or "", add_special_tokens=False).ids, 0])] += 1
    rows = packing.pack(docs, P.path("byte_bpe_50k.json"), capacity=64, piece=16).collect()
    sequences, pieces = defaultdict(list), defaultdict(set)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].add((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    for (i, ids), n in want.items():
        own = sorted(pieces[i])
        if sum(k == i for k, _ in want) == 1:
            at = 0
            for start, length, crc, total in own:
                assert start == at and total == len(ids)
                assert crc == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[start : start + length]))
                at += length
            assert at == len(ids)
    total = sum(len(ids) * n for (_, ids), n in want.items())
    assert sum(r.length for r in rows) == total
    assert packing.pack(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_long_texts_are_cut_where_tokens_end(monkeypatch):
    bpe = packing.ByteBPE(P.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    words = ["hello", "it's", "漢字", "12", "--", "a  b", "né", "\n\n", "x" * 40, "ﬁ", "🙂"]
    monkeypatch.setattr(packing, "CHUNK", 64)
    for odd in (False, True):
        text = " ".join(rng.choice([w for w in words if odd or max(map(ord, w)) < 0x2100]) for _ in range(400))
        assert len(packing.split_long(text)) > 10
        want = bpe.tokenizer.encode(text, add_special_tokens=False).ids
        assert bpe.encode([text])[0].tolist() == want and bpe.encode(["q", text, ""])[1].tolist() == want


def test_padding_of_the_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs, P.path("byte_bpe_50k.json")).select("sequence_id", "length").collect()
    assert sum(r.length for r in rows) > 0.97 * 1024 * len({r.sequence_id for r in rows})


def test_empty_tables_long_words_and_extra_columns(spark):
    long = [(1, "w" * 1_000_000 + " " + "ab " * 1000, "x"), (2, None, "y"), (None, " ", "z"), (None, " ", "z")]
    df = spark.createDataFrame(long, "doc_id long, text string, n_words string")
    out = sorted((str(r.doc_id), r.n_words) for r in tokens.token_counts(df, P.path("byte_bpe_50k.json")).collect())
    assert out == [("1", 1001), ("2", 0), ("None", 0), ("None", 0)]
    assert tokens.token_counts(df.limit(0), P.path("byte_bpe_50k.json")).count() == 0
    assert packing.pack(df, P.path("byte_bpe_50k.json")).where("doc_id = 2").collect()[0].doc_tokens == 1
    stats = quality.text_statistics(spark.createDataFrame([(1, "ab cd ef gh ij\n" * 40_000)], "doc_id long, text string"), "doc_id").first()
    assert (stats.n_words, stats.n_dup_lines, stats.n_repeat_words) == (200_000, 39_999, 200_000)


def test_differencing_balances():
    rng = random.Random(9)
    sizes = [rng.randint(1, 256) for _ in range(800)]
    found = packing.windows(sizes, 1024)
    assert sorted(i for g in found for i in g) == list(range(800))
    sums = [sum(sizes[i] for i in g) for g in found]
    assert max(sums) <= 1024 and max(sums) - min(sums) < 60 and len(sums) <= sum(sizes) / 1024 * 1.03 + 2


def test_chat_round_trip(spark):
    turns = [(1, 0, "system", "a\\0<|end|>\n"), (1, 1, "user", "[INST] \\1|>"), (1, 2, "assistant", "ok</s>"), (2, 0, "assistant", None), (2, 1, "we|>\nird", "<|user|>\nx"), (3, 5, "user", ""), (3, 5, "user", ""), (None, None, None, None), (4, 0, "user", "q"), (4, 1, "assistant", "\n")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df)
    got = {r.conv_id: r for r in out.select("conv_id", chat.parse_chats(out["formatted"]).alias("turns"), chat.loss_text(out["segments"]).alias("loss"), "valid", "formatted").collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted((t, r or "", x or "") for c, t, r, x in turns if c == conv for t in [t if t is not None else -1])
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(r, x) for _, r, x in own]
        assert got[conv]["loss"] == "".join(x for _, r, x in own if r == "assistant")
        assert got[conv]["formatted"].count("<|end|>") == len(own)
    assert {c for c, r in got.items() if r["valid"]} == {1, 4}
    assert chat.digest(chat.format_chats(df.limit(0))).count() == 0


def brute_statistics(text):
    text = text or ""
    ws = WORD.findall(text)
    grams = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    covered = {j for i in range(len(ws) - 4) if grams[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(docs):
    rows = quality.quality(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == Counter((i, *brute_statistics(t)) for i, t, *_ in corpus())
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    kept = Counter((r.doc_id, r.lang, r.source) for r in rows if r.kept)
    assert Counter((r.doc_id, r.lang, r.source) for r in quality.keep_good(docs).collect()) == kept
    assert quality.quality(docs.limit(0)).count() == 0 and quality.keep_good(docs.limit(0)).count() == 0
    odd = docs.withColumn("a", docs.doc_id).withColumn("b", docs.text).withColumn("_w", docs.lang).withColumn("mark1", docs.lang).withColumn("kept", docs.lang)
    assert quality.keep_good(odd).columns == odd.columns and quality.keep_good(odd).count() == sum(kept.values())
    assert quality.quality(odd).count() == len(rows)


def test_quality_rejects_the_odd_one(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 200))), "en", f"s{i % 2}", 0) for i in range(300)]
    bad = [(1000 + i, " ".join("abc%%%" + str(rng.random()) + "***" for _ in range(50)), "en", "s0", 0) for i in range(10)]
    out = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows + bad, SCHEMA)).collect()}
    assert all(out[i] for i in range(300)) and not any(out[1000 + i] for i in range(10))


def brute_verdicts(rows, least=100):
    """(distance2, kept) of rows by a plain minimum covariance determinant; ranks as percentile_approx takes them."""
    import math

    import numpy as np

    rank = lambda v, p: np.sort(v)[math.ceil(p * len(v)) - 1]
    x, failed, places = [], [], []
    for _, text, lang, source, _ in rows:
        n, chars, symbols, lines, repeats = brute_statistics(text)
        n_lines = sum(bool(WORD.search(line)) for line in (text or "").split("\n"))
        x.append([math.log(max(chars, 1) / max(n, 1)), math.log(1 + 100 * symbols / max(chars, 1)), math.log(1 + 10 * lines / max(n_lines, 1)), math.log(1 + 10 * repeats / max(n, 1))])
        failed.append(n < 10 or 100 * repeats > 20 * n)
        places.append((lang, source))
    x, failed, floor = np.array(x), np.array(failed), np.diag(np.square(quality.FLOOR))
    sizes = Counter(p for p, f in zip(places, failed, strict=True) if not f)
    groups = np.array(["/".join(p) if sizes[p] >= least else p[0] for p in places])
    d2 = np.zeros(len(rows))
    for g in set(groups):
        y = x[(groups == g) & ~failed]
        mean = np.array([rank(c, 0.5) for c in y.T])
        cov = np.diag([(1.4826 * rank(abs(c - m), 0.5)) ** 2 for c, m in zip(y.T, mean, strict=True)]) + floor
        far = lambda z, m, c: np.einsum("ij,ij->i", z - m, np.linalg.solve(c, (z - m).T).T)
        sd = np.sqrt(np.diag(cov))
        corr = np.clip(np.corrcoef(np.tanh((y - mean) / sd).T) if len(y) > 1 else np.eye(4), -0.95, 0.95)
        corr = np.where(np.eye(4) == 1, 1, np.nan_to_num(corr))
        first = [(mean, cov), (mean, corr * np.outer(sd, sd)), (y.mean(0), np.cov(y.T, bias=True) + floor)]
        ends = []
        for m, c in first:
            for _ in range(quality.STEPS):
                d = far(y, m, c)
                near = y[d <= rank(d, quality.SHARE)]
                m, new = near.mean(0), quality.CONSISTENCY * np.cov(near.T, bias=True) + floor
                done = abs(np.linalg.slogdet(new)[1] - np.linalg.slogdet(c)[1]) <= quality.SETTLED
                c = new
                if done:
                    break
            ends.append((np.linalg.slogdet(c)[1], m, c))
        det, mean, cov = min(ends, key=lambda e: round(e[0], 9))
        # No random start of the plain method ends lower by more than a little.
        rng = np.random.default_rng(1)
        for _ in range(40 if len(y) > 20 else 0):
            some = y[rng.choice(len(y), 6, replace=False)]
            m, c = some.mean(0), np.cov(some.T, bias=True) + floor
            for _ in range(30):
                near = y[(d := far(y, m, c)) <= rank(d, quality.SHARE)]
                m, c = near.mean(0), quality.CONSISTENCY * np.cov(near.T, bias=True) + floor
            assert np.linalg.slogdet(c)[1] > det - 0.05
        d2[groups == g] = far(x[groups == g], mean, cov)
    return {i: (d, not f and d <= quality.CUTOFF) for (i, *_), d, f in zip(rows, d2, failed, strict=True)}


def test_quality_rejects_repetition_as_a_plain_determinant_does(spark):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))
    rows = [(i, "\n".join(text(rng.randint(8, 15)) for _ in range(rng.randint(2, 12))) + " %" * rng.choice([0, 0, 0, 1]), "en", rng.choice(["s0", "s1"]), 0) for i in range(320)]
    rows += [(500 + i, text(60), "en", "few", 0) for i in range(30)]
    lines = [(1000 + i, "\n".join(text(14) + "\nread on" for _ in range(20)), "en", "s0", 0) for i in range(5)]  # short equal lines: no five words repeat
    passage = [(2000 + i, f"{(p := text(9))} {text(82)} {p}", "en", "s1", 0) for i in range(5)]  # 18 % of words repeat
    every = rows + lines + passage
    assert all(brute_statistics(t)[4] == 0 for _, t, *_ in lines) and all(100 * (s := brute_statistics(t))[4] <= 20 * s[0] for _, t, *_ in passage)
    out = {r.doc_id: (r.distance2, r.kept) for r in quality.quality(spark.createDataFrame(every, SCHEMA)).collect()}
    want = brute_verdicts(every)
    assert {i: k for i, (_, k) in out.items()} == {i: k for i, (_, k) in want.items()}
    assert {i: d for i, (d, _) in out.items()} == pytest.approx({i: d for i, (d, _) in want.items()}, rel=1e-3, abs=1e-6)  # all groups stop together, a plain one alone
    assert all(out[i][1] for i, *_ in rows) and not any(out[i][1] for i, *_ in lines + passage)


def test_quality_steps_leave_settled_groups(spark, monkeypatch):
    rng, seen, step = random.Random(2), [], quality.concentrate
    rows = [("same", 1.0, 0.0, 0.0, 0.0)] * 200 + [("far", rng.gauss(0, 1), rng.gauss(0, 2), rng.expovariate(1), rng.expovariate(3)) for _ in range(300)]

    def recorded(rows, params):
        seen.append({r.grp for r in params.select("grp").collect()})
        return step(rows, params)

    monkeypatch.setattr(quality, "concentrate", recorded)
    out = {r.grp for r in quality.estimate(spark.createDataFrame(rows, "grp string, x0 double, x1 double, x2 double, x3 double")).collect()}
    assert out == {"same", "far"} and seen[0] == out and len(seen) > 1 and all(s == {"far"} for s in seen[1:])


def brute_fingerprint(text, k=4, w=8):
    """(place, hash) of the chosen grams, by rolling from gram to gram."""
    import xxhash

    p, base = (1 << 33) - 9, 479_001_599
    hs = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in WORD.findall(text or "")]
    hs = [(h - (1 << 64) if h >> 63 else h) % p for h in hs]
    if not hs:
        return []
    rolled, h = [], 0
    for i, x in enumerate(hs):
        h = (h * base + x - (hs[i - k] * pow(base, k, p) if i >= k else 0)) % p
        if i >= k - 1:
            rolled.append(h)
    rolled = rolled or [h]
    chosen = []
    for s in range(max(len(rolled) - w + 1, 1)):
        window = rolled[s : s + w]
        at = s + max(j for j, x in enumerate(window) if x == min(window))
        if not chosen or chosen[-1][0] != at:
            chosen.append((at, rolled[at]))
    return chosen


def brute_likeness(a, b):
    x, y = {h for _, h in a}, {h for _, h in b}
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("per_bucket", [4000, 3])
def test_fingerprints_and_edits(docs, spark, monkeypatch, per_bucket):
    monkeypatch.setattr(winnow.with_next, "__defaults__", (per_bucket,))
    rows = [(i, t) for i, t, *_ in corpus() if i is not None][:-1]
    rows += [(10**15 + i, " ".join(random.Random(i).choice("abcd") for _ in range(60))) for i in range(9)]  # far from the rest
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in winnow.compare_with_edits(df.repartition(5)).collect()}
    assert len(out) == len(rows)
    shown = lambda f: " ".join(f"{at}:{h:X}" for at, h in f)
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        own, changed, after = map(brute_fingerprint, (t, edited, nxt))
        assert out[i].n_chars == len(t) and out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert out[i].fingerprint == shown(own) and out[i].edited_fingerprint == shown(changed)
        assert out[i].near_edited == pytest.approx(brute_likeness(own, changed)) and out[i].near_next == pytest.approx(brute_likeness(own, after))
    small = winnow.with_next(df.select("doc_id", "text").na.fill(""), rows_per_bucket=3)[0]
    sizes = [r["count"] for r in small.where("helper = 0").groupBy("bucket").count().collect()]
    assert len(sizes) > 10 and max(sizes) <= 8
    assert winnow.compare_with_edits(df.limit(0)).count() == 0
    assert winnow.compare_with_edits(docs.select("doc_id", "text")).count() == len(corpus())


def test_rows_without_ids_fill_no_bucket(spark):
    df = spark.range(600).selectExpr("if(id < 400, null, if(id < 500, 7, id)) AS doc_id", "concat('text ', id) AS text")
    sizes = [r["count"] for r in winnow.with_next(df, rows_per_bucket=20)[0].where("helper = 0").groupBy("bucket").count().collect()]
    assert sum(sizes) == 600 and max(sizes) <= 60


def test_fingerprints_keep_other_columns(spark):
    text = " ".join(random.Random(2).choice("abcd") for _ in range(400))
    df = spark.createDataFrame([(1, text, "w", "g", "s"), (2, None, "w", "g", "s")], "doc_id long, text string, words string, grams string, selected string")
    out = {r.doc_id: r for r in winnow.fingerprints(df).collect()}
    mask = (1 << winnow.PLACE) - 1
    assert [(mask - (v & mask), v >> winnow.PLACE) for v in out[1].selected] == brute_fingerprint(text)
    assert out[2].selected == [] and out[2].words == "w" and out[2].grams == "g"


def test_mixing_keeps_all_and_meets_targets(docs, spark):
    out = mixing.mix(docs, repetition=1.5)
    assert {(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()} == {(i, t) for i, t, *_ in corpus()}
    sources = spark.createDataFrame([("a", 10, 1000), ("b", 10, 100), ("c", 5, 0)], "source string, n_docs long, tokens long")
    import math

    got = {r.source: r for r in mixing.solve(sources, entropy=0.9, repetition=None, budget=1.0).collect()}
    w = [got["a"].weight, got["b"].weight]
    assert abs(sum(w) - 1) < 1e-6 and abs(-sum(x * math.log(x) for x in w) - 0.9 * math.log(2)) < 1e-5
    got = {r.source: r for r in mixing.solve(sources, entropy=None, repetition=2.0, budget=None).collect()}
    assert abs(got["b"].epochs - 2) < 1e-4 and got["a"].epochs == 1 and got["c"].weight == 0
    # By a plain search: the greatest exponent that no source is read more than twice at, on half the tokens.
    three = spark.createDataFrame([("a", 10, 1000), ("b", 10, 100), ("c", 5, 30)], "source string, n_docs long, tokens long")
    counts, total = [1000, 100, 30], 1130
    epochs = lambda e: max(0.5 * total * (c / total) ** e / sum((d / total) ** e for d in counts) / c for c in counts)
    got = mixing.solve(three, entropy=None, repetition=2.0, budget=0.5).collect()
    assert abs(epochs(got[0].exponent) - 2) < 1e-6 and max(r.epochs for r in got) <= 2 + 1e-6
    best = lambda e: -sum((w := (c / total) ** e / sum((d / total) ** e for d in counts)) * math.log(w) for c in counts)
    e = mixing.solve(three, entropy=0.8, repetition=None, budget=1.0).first().exponent
    assert abs(best(e) - 0.8 * math.log(3)) < 1e-7
    assert mixing.mix(docs.limit(0)).count() == 0
    odd = docs.withColumns({c: docs.lang for c in ("_blocks", "_source", "src", "blocks", "h", "cum", "epoch", "every", "tokens", "n_docs")})
    assert mixing.mix(odd).count() == mixing.mix(docs).count() and set(odd.columns) <= set(mixing.mix(odd).columns)
