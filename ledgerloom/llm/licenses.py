"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory above."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut
from .license_texts import templates

# What a text must hold to be looked at.
TRIGGERS = ("licen", "copyright", "permission", "permitted", "public domain", "redistribut", "free software", "unencumbered", "as-is", "spdx", "creative commons", "cc by", "cc0", "boost software", "general public", "mozilla public")
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)[^/]*$"
#: Cosine that counts as a match, and the share of a file's characters in matched passages that makes it a licence file.
THRESHOLD, WHOLE = 0.75, 0.5
#: How many adjacent lines or sentences a passage takes, from one with a trigger on.
SPANS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
SEGMENT = re.compile(r"\n|(?<=[.;:])[ \t]+")


def terms(text: str) -> list[str]:
    return [t for t in re.split(r"[^a-z0-9]+", text.lower()) if t]


def triggered(text: Column) -> Column:
    low = F.lower(text)
    hit = F.lit(False)
    for t in TRIGGERS:
        hit = hit | low.contains(t)
    return hit


def segments(text: str) -> tuple[list[str], list[int]]:
    """Lines, long ones cut into sentences, and the places of those with a trigger."""
    out = [x for x in SEGMENT.split(text) if x.strip()]
    return out, [i for i, x in enumerate(out) if any(t in x.lower() for t in TRIGGERS)]


def passages(path: str, text: str) -> list[tuple[int, int]]:
    """Runs [a, b) of segments that are scored: from every trigger on, SPANS long as far as the text goes, and the whole of a licence file."""
    segs, hits = segments(text)
    runs = {(i, min(i + n, len(segs))) for i in hits for n in SPANS}
    if re.search(LICENCE_FILE, path):
        runs.add((0, len(segs)))
    return sorted(runs)


class Scorer:
    """Unit TF-IDF vectors of the templates; terms that no template has weigh 1."""

    def __init__(self, n: int, df: dict[str, int]):
        import math

        import numpy as np

        self.found = [(name, Counter(terms(text))) for name, text in templates()]
        self.known = {t: i for i, t in enumerate(sorted({t for _, c in self.found for t in c}))}
        self.idf = np.array([math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in self.known])
        self.matrix = np.zeros((len(self.found), len(self.known)))
        for row, (_, counts) in zip(self.matrix, self.found, strict=True):
            for t, c in counts.items():
                row[self.known[t]] = c
        self.matrix *= self.idf
        self.matrix /= np.linalg.norm(self.matrix, axis=1, keepdims=True)
        self.names = [name for name, _ in self.found]

    def best(self, path: str, text: str) -> tuple[str, float, float, int, int] | None:
        """(licence, cosine, weight, matched triggers, characters under matched passages), the first name among equals, or None.

        Of the passages that match, the one counts of which its template explains most, cosine times length of the vector: a
        licence that holds a shorter one whole is then not taken for it."""
        import numpy as np

        segs, _ = segments(text)
        split = {}
        found, covered, starts = [], set(), set()
        vector, other, square, at = np.zeros(len(self.known)), Counter(), 0, (-1, -1)
        for a, b in passages(path, text):
            if a != at[0]:
                vector, other, square, at = np.zeros(len(self.known)), Counter(), 0, (a, a)
            for i in range(at[1], b):
                if i not in split:
                    split[i] = terms(segs[i])
                for t in split[i]:
                    k = self.known.get(t)
                    if k is not None:
                        vector[k] += 1
                    else:
                        square += 2 * other[t] + 1
                        other[t] += 1
            at = (a, b)
            v = vector * self.idf
            norm = float(v @ v + square) ** 0.5
            if not norm:
                continue
            score = np.round(self.matrix @ v / norm, 9)
            top = float(score.max())
            if top >= THRESHOLD:
                found.append((-round(top * norm, 6), min(n for n, s in zip(self.names, score, strict=True) if s == top), -top))
                covered.update(range(a, b))
                starts.add(a)
        if not found:
            return None
        weight, name, score = min(found)
        return name, -score, -weight, len(starts), sum(len(segs[i]) for i in covered)


def frequencies(found: DataFrame) -> tuple[int, dict[str, int]]:
    """Files with a trigger, and in how many of them passages hold each term of the templates: at most one row a template term comes to the driver."""
    known = {t for _, x in templates() for t in terms(x)}

    def run(batches):
        import pyarrow as pa

        count: Counter = Counter()
        for batch in batches:
            for path, text in zip(*(batch.column(c).to_pylist() for c in ("path", "text")), strict=True):
                segs, _ = segments(text)
                inside = {i for a, b in passages(path, text) for i in range(a, b)}
                count.update({t for i in inside for t in terms(segs[i])} & known)
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["t", "n"])

    rows = found.select("path", "text").mapInArrow(run, "t string, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
    return found.count(), {r.t: r.n for r in rows}


def score(found: DataFrame, n: int, df: dict[str, int]) -> DataFrame:
    """(path, license, score, weight, n_passages, chars) of the files with a passage that matches."""
    def run(batches):
        import pyarrow as pa

        scorer = Scorer(n, df)
        for batch in batches:
            rows = []
            for path, text in zip(*(batch.column(c).to_pylist() for c in ("path", "text")), strict=True):
                if best := scorer.best(path, text):
                    rows.append((path, *best))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["path", "license", "score", "weight", "n_passages", "chars"])

    return found.select("path", "text").mapInArrow(run, "path string, license string, score double, weight double, n_passages long, chars long")


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def scan(files: DataFrame, whole: float = WHOLE) -> DataFrame:
    """(path, own_license, own_score, n_passages, licence_file, license, origin, origin_dir), a row a distinct path of files(path, text).

    origin is `own` for a match in the file, `inherited` for that of the nearest directory above that holds a licence file
    (its best score, then least name), or null. The empty directory is the root. Null texts and empty files only inherit;
    rows of one path are one file; null paths have the path ''. Texts are scored whole, however long; an empty table gives an
    empty one; other columns of files are left out."""
    files = files.select(F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    found = cut(files.where(triggered(F.col("text"))))
    matched = score(found, *frequencies(found))
    best = F.min(F.struct((-F.col("weight")).alias("w"), "license", (-F.col("score")).alias("s"))).alias("best")
    own = matched.groupBy("path").agg(best, F.sum("n_passages").alias("n_passages"), F.sum("chars").alias("chars")).select("path", F.col("best.license").alias("own_license"), (-F.col("best.s")).alias("own_score"), "n_passages", "chars")
    every = files.groupBy("path").agg(F.sum(F.length("text")).alias("all")).join(own, "path", "left")
    every = cut(every.select("path", parent(F.col("path")).alias("dir"), "own_license", "own_score", F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"),
        (F.col("own_license").isNotNull() & (F.col("path").rlike(LICENCE_FILE) | (F.col("chars") >= whole * F.col("all")))).alias("licence_file")))
    held = every.where("licence_file").groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "own_license")).alias("x")).select(F.col("dir").alias("above"), F.col("x.own_license").alias("inherited"))
    dirs = every.select("dir").distinct()
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))).alias("above")).distinct()
    nearest = up.join(held, "above").groupBy("dir").agg(F.max_by("inherited", F.length("above")).alias("inherited"), F.max_by("above", F.length("above")).alias("origin_dir"))
    out = every.join(nearest, "dir", "left")
    has = F.col("own_license").isNotNull()
    return out.select("path", "own_license", "own_score", "n_passages", F.coalesce("licence_file", F.lit(False)).alias("licence_file"), F.coalesce("own_license", "inherited").alias("license"),
        F.when(has, "own").when(F.col("inherited").isNotNull(), "inherited").alias("origin"), F.when(~has, F.col("origin_dir")).alias("origin_dir"))


def document_path(docs: DataFrame) -> Column:
    """source/lang/block of 64 ids/id, as documents have no paths of their own."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    return F.concat_ws("/", part("source"), part("lang"), F.coalesce(F.floor(F.col("doc_id") / 64).cast("string"), F.lit("none")), part("doc_id"))
