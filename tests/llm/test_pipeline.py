"""The whole pipeline, stage by stage, against brute force."""

import random
import re
from collections import Counter

import pytest

pytest.importorskip("ledgerloom.llm")
pipeline = pytest.importorskip("corpus_pipeline")
from test_neardup import brute as components  # noqa: E402
from test_text_ops import brute_statistics, brute_verdicts  # noqa: E402

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))
    shared = [text(53) for _ in range(3)]
    rows = []
    for i in range(150):
        t = text(rng.randint(30, 120))
        if i % 10 == 0:
            t = f"{t}\n{rng.choice(shared).replace(' ', rng.choice([' ', '  ']))}\n{text(70)}"
        rows.append([t, "en", f"s{i % 3 // 2}"])
    for i in range(0, 60, 4):
        words = rows[i][0].split(" ")
        rows.append([" ".join(words if i % 8 else [*words, "more"]), "en", "s0"])  # copies and near copies
    rows += [[" ".join(["again and again we go"] * 20), "en", "s0"], ["too short", "en", "s1"], [None, None, None], [text(60) + " %$#*" * 40, "en", "s0"], [text(90), None, None]]
    rng.shuffle(rows)
    return [(i, *r, len(r[0] or "")) for i, r in enumerate(rows)]


def without_passages(rows):
    seen = Counter()
    for r in rows:
        ws = WORD.findall(r[1] or "")
        seen.update(tuple(ws[i : i + 50]) for i in range(len(ws) - 49))
    out = []
    for r in rows:
        places = [m.span() for m in WORD.finditer(r[1] or "")]
        ws = [r[1][a:b] for a, b in places]
        gone = {j for i in range(len(ws) - 49) if seen[tuple(ws[i : i + 50])] > 1 for j in range(i, i + 50)}
        kept, at, j = "", 0, 0
        while j < len(ws):
            if j in gone:
                kept += r[1][at : places[j][0]]
                while j in gone:
                    j += 1
                at = places[j][0] if j < len(ws) else places[-1][1]
            else:
                j += 1
        text = kept + r[1][at:] if r[1] is not None else None
        out.append((r[0], text, r[2], r[3], len(text) if gone else r[4]))
    return out


def test_run_is_its_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    from ledgerloom.llm.queries import vocabulary

    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "near_duplicates", "suffix_array", "mix_sources", "pack"]
    docs, want = spark.read.parquet(f"{tmp_path}/documents.parquet"), rows
    for name, stage in pipeline.STAGES[:4]:
        before, docs = want, stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got = sorted(map(tuple, docs.collect()), key=lambda r: r[0])
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality_rules":
            verdicts = brute_verdicts([(i, t, lang or "~", source or "~", n) for i, t, lang, source, n in before])
            want = [r for r in before if verdicts[r[0]][1]]
            assert len(before) > len(want) >= 0.9 * len(before)
        elif name == "near_duplicates":
            least = {d: c for d, _, c in components([(r[0], r[1]) for r in before], 5, 80)}
            want = [r for r in before if least[r[0]] == r[0]]
            assert len(want) < len(before)
        elif name == "suffix_array":
            want = without_passages(before)
            assert sum(a != b for a, b in zip(want, before, strict=True)) >= 5
        else:  # every row once, those of a small source up to twice, 1.25 times in all
            times = Counter(r[0] for r in got)
            assert set(times) == {r[0] for r in before} and max(times.values()) <= 2 and set(got) == set(before)
            for source in {r[3] for r in before}:
                own = [r for r in before if r[3] == source]
                size = lambda r: len(WORD.findall(r[1] or ""))
                assert sum(times[r[0]] * size(r) for r in own) <= 1.3 * sum(map(size, own)) + 200
            want = got
        assert got == want, name
    tokenizer, size = Tokenizer.from_file(vocabulary()), Counter()
    for r in want:
        size[r[0]] += len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1
    packed = pipeline.run(spark, str(tmp_path)).collect()
    found = Counter()
    for r in packed:
        found[r.doc_id] += r.length
    assert found == size
    assert max(Counter({s: sum(r.length for r in packed if r.sequence_id == s) for s in {r.sequence_id for r in packed}}).values()) <= 1024


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)) if "text" in docs.columns else docs
        assert docs.count() == 0


def test_statistics_are_the_contracts():
    assert brute_statistics("a b\na b\n")[:4] == (4, 4, 0, 1)
