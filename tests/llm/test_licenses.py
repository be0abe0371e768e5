"""License scans against brute force."""

import math
import re
from collections import Counter

import pytest

pytest.importorskip("ledgerloom.llm")
from ledgerloom.llm import license_texts as T  # noqa: E402
from ledgerloom.llm import licenses as L  # noqa: E402

GPL = "This work is licensed under the GNU General Public License, version 3."
WRAPPED = "# " + T._MIT[:76] + "\n# " + T._MIT[76:160] + "\n# " + T._MIT[160:300] + "\n#  " + T._MIT[300:]
FILES = [
    ("a/LICENSE", "Released under the MIT License."), ("a/x.py", "print(1)\nno notice"), ("a/b/y.py", "text"), ("a/b/c/z.py", GPL + "\n" + "code " * 40),
    ("a/d/COPYING", GPL), ("a/d/e/f.py", "q"), ("g/h.py", None), ("g/i.py", ""), ("top.py", "the permission of words"), ("j/k.txt", "Licensed under CC BY-NC 4.0."),
    ("j/m.txt", "inherits"), (None, "Licensed under the Apache License, Version 2.0.\n" + "x " * 200), ("a/x.py", "print(1)\nno notice"),
    ("s/tag.c", "// SPDX-License-Identifier: MIT\nint main;"), ("s/later.c", "/* SPDX-License-Identifier: GPL-2.0-or-later */"), ("s/wrapped.py", WRAPPED + "\n\nimport os\n" * 3),
    ("s/LICENSE.txt", "Copyright (c) 2020 Someone. All rights reserved.\n\n" + T._BSD.replace(": 1.", ":\n\n1.") + "\n\n" + T._BSD_THIRD + "\n\n" + T._BSD_WARRANTY[:320]),
    ("s/full", "MIT License\n\nCopyright (c) 2021 Me\n\n" + T._MIT + "\n\n" + T._WARRANTY), ("s/gpl.py", "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.\nx = 1"),
    ("s/para.md", "Some words go before, and then there is more of them to read. Released under the MIT License. And after it the words go on, for as long as they like, on one line."),
    ("s/cc.md", "This text is CC BY 4.0."), ("s/or.md", "GNU General Public License, version 2 or later"), ("s/prose.md", "He asked for permission to copy the licence plate number, and the public liked the free software talk."),
]
WANT = {"s/tag.c": "MIT", "s/later.c": "GPL-2.0-or-later", "s/wrapped.py": "MIT", "s/LICENSE.txt": "BSD-3-Clause", "s/full": "MIT", "s/gpl.py": "GPL-2.0-or-later", "s/para.md": "MIT", "s/cc.md": "CC-BY-4.0", "s/or.md": "GPL-2.0-or-later"}


def brute():
    """Every passage's cosine to every template by plain counters."""
    words = lambda x: re.findall("[a-z0-9]+", x.lower())
    vectors = [(n, Counter(words(x))) for n, x in T.templates()]
    known = {t for _, v in vectors for t in v}
    named = lambda p: any(p.lower().rsplit("/", 1)[-1].startswith(k) for k in ("license", "licence", "copying", "unlicense", "notice"))
    files, df, n = [], Counter(), 0
    for p, t in FILES:
        p, t = p or "", t or ""
        segs = [s for line in t.split("\n") for s in re.split(r"(?<=[.;:])[ \t]+", line) if s.strip()]
        hits = [i for i, s in enumerate(segs) if any(k in s.lower() for k in L.TRIGGERS)]
        runs = [(i, min(i + k, len(segs))) for i in hits for k in (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)] + ([(0, len(segs))] if named(p) else [])
        if any(k in t.lower() for k in L.TRIGGERS):
            n += 1
            df.update({w for a, b in runs for s in segs[a:b] for w in words(s)} & known)
        else:
            runs = []
        files.append((p, t, segs, runs))
    idf = lambda t: math.log((1 + n) / (1 + df[t])) + 1 if t in known else 1.0
    norm = lambda v: math.sqrt(sum((c * idf(t)) ** 2 for t, c in v.items()))
    own, texts = {}, {}
    for p, t, segs, runs in files:
        texts.setdefault(p, []).append(t)
        covered = set()
        for a, b in runs:
            v = Counter(w for s in segs[a:b] for w in words(s))
            best = min((-round(sum(c * x.get(t, 0) * idf(t) ** 2 for t, c in v.items()) / norm(v) / norm(x), 9), name) for name, x in vectors) if v else (0, "")
            if -best[0] >= 0.75:
                covered.update(range(a, b))
                own.setdefault(p, []).append((round(best[0] * norm(v), 6), best[1], best[0]))
        if covered and (named(p) or sum(len(segs[i]) for i in covered) >= 0.5 * len(t)):
            own[p].append(("held",))
    held = {}
    for p, found in own.items():
        best = min(x for x in found if x != ("held",))
        if ("held",) in found:
            d = p.rsplit("/", 1)[0] if "/" in p else ""
            held[d] = min(held.get(d, (best[2], best[1])), (best[2], best[1]))
        own[p] = best
    out = {}
    for p in texts:
        if p in own:
            out[p] = (own[p][1], "own", None)
            continue
        d = p.rsplit("/", 1)[0] if "/" in p else ""
        while d not in held and d:
            d = d.rsplit("/", 1)[0] if "/" in d else ""
        out[p] = (held[d][1], "inherited", d) if d in held else (None, None, None)
    return out


def test_scan(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in FILES], "path string, text string, license string, dir string")
    out = L.scan(df).collect()
    assert {r.path: (r.license, r.origin, r.origin_dir) for r in out} == brute() and len(out) == len(brute())
    got = {r.path: r.license for r in out}
    assert got["a/b/y.py"] == "MIT" and got["a/d/e/f.py"] == "GPL-3.0-only" and got["a/b/c/z.py"] == "GPL-3.0-only" and got["j/m.txt"] == "CC-BY-NC-4.0" and got["top.py"] is None
    assert {p: got[p] for p in WANT} == WANT
    assert {r.path: r.own_license for r in out}["s/prose.md"] is None
    assert L.scan(df.limit(0)).count() == 0


def test_long_texts_and_many_triggers(spark):
    text = "\n".join(["this line has a licence in it"] * 3000 + [GPL] + ["words"] * 30000)
    assert L.scan(spark.createDataFrame([("x/y", text)], "path string, text string")).first().own_license == "GPL-3.0-only"


def test_templates_match_themselves():
    scorer = L.Scorer(0, {})
    for name, text in T.templates():
        found = L.Scorer(0, {}).best("LICENSE", text) if name == "MIT" else scorer.best("LICENSE", text)
        assert found and found[1] == pytest.approx(1, abs=1e-6), (name, text, found)
        assert found[0] == name, (name, text, found)
