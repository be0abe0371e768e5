"""Quality rules: counts over whole texts, then robust multivariate outliers per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import SPACES, cut, fresh, small, words

# Symbols counted, the windows' length, and the rule on words and repetition.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: chi-square with 4 degrees: the share h = 0.75 of the half-sample, its consistency factor, and the 0.99999 quantile that rejects.
SHARE, CONSISTENCY, CUTOFF = 0.75, 1.486, 28.47
#: Spread that every group is granted at least: log word length, then logs of 1 + 100 symbols a character, 1 + 10 repeated lines a line, 1 + 10 repeated words a word.
#: In a group without repetition the last two alone reject from some 30 % repeated lines or 15 % repeated words on.
FLOOR = (0.15, 0.35, 0.26, 0.17)
#: Concentration steps at most, and the change of a log determinant that ends them.
STEPS, SETTLED = 12, 1e-4
#: Quantiles are off by one rank in so many at most, exact for smaller groups: with coarser ones the steps of a large group never settle.
RANKS = 10_000
DIM = range(len(FLOOR))
KEY = ("doc_id", "lang", "source")


def text_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and base_failed; null texts have no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*keep, text.alias("_t"), words(text).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    windows = F.when(F.size("_w") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), lambda i: F.xxhash64(*[F.get("_w", i + j) for j in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    df = df.select(*keep, F.size("_w").cast("long").alias("n_words"), lines.alias("_l"), windows.alias("_h"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"))
    df = df.withColumns({"n_lines": F.size("_l").cast("long"), "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
                         "_repeats": F.size(F.array_distinct("_h")) < F.size("_h")})
    df = df.withColumn("n_repeat_words", F.when(F.col("_repeats"), _covered("_h")).otherwise(F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", failed.alias("base_failed"))


def _covered(h: str) -> Column:
    """Words under windows that occur twice or more: windows sorted by hash and place, those with an equal neighbour kept, their places merged."""
    return F.expr(f"""aggregate(
        array_sort(flatten(transform(array(array_sort(transform({h}, (x, i) -> named_struct('h', x, 'i', i)))),
            p -> transform(filter(p, (e, j) -> get(p, j - 1).h <=> e.h OR get(p, j + 1).h <=> e.h), e -> e.i)))),
        named_struct('n', 0, 'end', 0),
        (a, i) -> named_struct('n', a.n + i + {WINDOW} - greatest(a.end, i), 'end', i + {WINDOW}), a -> a.n)""")


def features(stats: DataFrame) -> DataFrame:
    """x0..x3: the transformed vector."""
    n, w, lines = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return stats.withColumns({"x0": F.ln(w / n), "x1": F.ln(1 + 100 * F.col("n_symbols") / w), "x2": F.ln(1 + 10 * F.col("n_dup_lines") / lines), "x3": F.ln(1 + 10 * F.col("n_repeat_words") / n)})


def _cholesky(cov: dict[tuple[int, int], Column]) -> list[list[tuple[str, Column]]]:
    """Names and expressions of the lower triangle, a level at a time, as later entries refer to earlier ones by name."""
    levels = []
    for j in DIM:
        diag = cov[j, j] - sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        levels.append([(f"l{j}{j}", F.sqrt(F.greatest(diag, F.lit(1e-9))))])
        levels.append([(f"l{i}{j}", (cov[i, j] - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}")) for i in DIM if i > j])
    return [x for x in levels if x]


PARAMETERS = [f"m{i}" for i in DIM] + [f"l{i}{j}" for i in DIM for j in range(i + 1)]


def distance(df: DataFrame) -> DataFrame:
    """df(x*, m*, l**) plus d2, the squared Mahalanobis distance by forward substitution."""
    for i in DIM:
        df = df.withColumn(f"y{i}", (F.col(f"x{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{j}") * F.col(f"y{j}") for j in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return df.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in DIM), F.lit(0.0))).drop(*[f"y{i}" for i in DIM])


def _moments(prefix: str, x: list[Column]) -> list[Column]:
    """Means and mean products of x."""
    return [*[F.avg(x[i]).alias(f"{prefix}a{i}") for i in DIM], *[F.avg(x[i] * x[j]).alias(f"{prefix}q{i}{j}") for i in DIM for j in range(i + 1)]]


def _covariance(prefix: str, factor: float = 1.0) -> dict[tuple[int, int], Column]:
    return {(i, j): factor * (F.col(f"{prefix}q{i}{j}") - F.col(f"{prefix}a{i}") * F.col(f"{prefix}a{j}")) for i in DIM for j in range(i + 1)}


def _granted(cov: dict[tuple[int, int], Column]) -> dict[tuple[int, int], Column]:
    return {(i, j): c + FLOOR[i] ** 2 if i == j else c for (i, j), c in cov.items()}


def _parameters(df: DataFrame, start: int | None, cov: dict[tuple[int, int], Column], *keep: str) -> DataFrame:
    """(grp, start, m*, l**, logdet) and `keep` from df with m* and a covariance."""
    for level in _cholesky(cov):
        df = df.withColumns(dict(level))
    df = df if start is None else df.withColumn("start", F.lit(start))
    return df.select("grp", "start", *PARAMETERS, sum((2 * F.ln(f"l{i}{i}") for i in DIM), F.lit(0.0)).alias("logdet"), *keep)


def starts(rows: DataFrame) -> DataFrame:
    """Three first estimates of rows(grp, x*): median deviations alone; those with the correlations of tanh((x - median) / deviation), which far rows hardly move; and plain moments."""
    med = cut(rows.groupBy("grp").agg(*[F.percentile_approx(f"x{i}", 0.5, 2000).alias(f"m{i}") for i in DIM]))
    dev = cut(rows.join(small(med), "grp").groupBy("grp").agg(*[F.first(f"m{i}").alias(f"m{i}") for i in DIM], *[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 2000).alias(f"s{i}") for i in DIM]))
    spread = [F.sqrt(F.pow(1.4826 * F.col(f"s{i}"), 2) + FLOOR[i] ** 2) for i in DIM]
    centred = rows.join(small(dev), "grp")
    c = [F.col(f"x{i}") - F.col(f"m{i}") for i in DIM]
    both = centred.groupBy("grp").agg(*[F.first(f"{k}{i}").alias(f"{k}{i}") for k in "ms" for i in DIM], *_moments("p", c), *_moments("t", [F.tanh(c[i] / spread[i]) for i in DIM]))
    both = cut(both)
    diagonal = {(i, j): F.pow(spread[i], 2) if i == j else F.lit(0.0) for i in DIM for j in range(i + 1)}
    t = _covariance("t")
    sd = [F.sqrt(F.greatest(t[i, i], F.lit(1e-12))) for i in DIM]
    tanh = {(i, j): F.pow(spread[i], 2) if i == j else spread[i] * spread[j] * F.greatest(F.least(t[i, j] / sd[i] / sd[j], F.lit(0.95)), F.lit(-0.95)) for i in DIM for j in range(i + 1)}
    moved = both.withColumns({f"m{i}": F.col(f"m{i}") + F.col(f"pa{i}") for i in DIM})
    return _parameters(both, 0, diagonal).unionByName(_parameters(both, 1, tanh)).unionByName(_parameters(moved, 2, _granted(_covariance("p"))))


def concentrate(rows: DataFrame, params: DataFrame) -> DataFrame:
    """One concentration step of every (grp, start): the SHARE of a group nearest by Mahalanobis distance gives the next estimate, with the log determinant before as `old`."""
    near = distance(rows.join(small(params.withColumnRenamed("logdet", "old")), "grp"))
    limit = cut(near.groupBy("grp", "start").agg(F.percentile_approx("d2", SHARE, RANKS).alias("limit")))
    kept = near.join(small(limit), ["grp", "start"]).where("d2 <= limit")
    # Moments about the old centre, so that large means cost no digits.
    c = [F.col(f"x{i}") - F.col(f"m{i}") for i in DIM]
    sums = kept.groupBy("grp", "start").agg(F.first("old").alias("old"), *[F.first(f"m{i}").alias(f"o{i}") for i in DIM], *_moments("p", c))
    return _parameters(sums.withColumns({f"m{i}": F.col(f"o{i}") + F.col(f"pa{i}") for i in DIM}), None, _granted(_covariance("p", CONSISTENCY)), "old")


def estimate(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """(grp, m*, l**): deterministic minimum-covariance-determinant estimates of rows(grp, x*).

    From each of the three `starts`, concentration steps go on until the log determinant changes by no more than SETTLED, or
    `steps` are done; a group and start that has settled takes no further step. Of the three ends of a group that of the least
    determinant counts, the first of equals. FLOOR squared is added to every variance, so constant features stay regular. All
    statistics are mergeable aggregates, so a group may hold any share of the rows."""
    moving, params = cut(starts(rows)), None
    for _ in range(steps):
        stepped = cut(concentrate(rows, moving))
        moves = F.abs(F.col("logdet") - F.col("old")) > SETTLED
        ended, moving = stepped.where(~moves).drop("old"), stepped.where(moves).drop("old")
        params = ended if params is None else params.unionByName(ended)
        if moving.isEmpty():
            break
    params = moving if params is None else params.unionByName(moving)
    best = params.groupBy("grp").agg(F.min(F.struct(F.round("logdet", 9).alias("d"), "start", *PARAMETERS)).alias("b"))
    return cut(best.select("grp", *[F.col(f"b.{p}").alias(p) for p in PARAMETERS]))


def judge(stats: DataFrame, least: int = 100) -> DataFrame:
    """stats plus distance2 and kept: base rules passed and no outlier of its language and source.

    Groups of under `least` passing documents are judged with their language's; null languages and sources are groups."""
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in ("lang", "source"))
    rows = features(stats).withColumns({"_lang": lang, "_ls": F.concat_ws("/", lang, source)})
    passing = rows.where(~F.col("base_failed"))
    counts = cut(passing.groupBy("_ls").agg(F.count(F.lit(1)).alias("_n")))
    grouped = rows.join(small(counts), "_ls", "left").withColumn("grp", F.when(F.col("_n") >= least, F.col("_ls")).otherwise(F.col("_lang")))
    params = estimate(grouped.where(~F.col("base_failed")).select("grp", *[f"x{i}" for i in DIM]))
    judged = distance(grouped.join(small(params), "grp", "left"))
    verdict = ~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(True))
    return judged.select(*stats.columns, F.col("d2").alias("distance2"), verdict.alias("kept"))


def quality(docs: DataFrame) -> DataFrame:
    """A row a row of docs(doc_id, text, lang, source): statistics, base_failed, distance2, kept.

    Null texts have no words and fail; null ids, languages and sources stay; repeated rows are judged alike; other columns are
    left out, whatever their names. Empty tables give empty results."""
    return judge(cut(text_statistics(docs.select(*KEY, "text"), *KEY)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with their columns, whatever their names. Verdicts are found by a 128-bit hash of the row's id, language, source and text; texts move once."""
    a, b = fresh(docs, "a", "b")
    marked = docs.withColumns({a: F.xxhash64(*KEY, "text"), b: F.xxhash64(F.lit(7), "text", *KEY)})
    slim = marked.select(*KEY, "text", F.col(a).alias("mark1"), F.col(b).alias("mark2"))
    good = judge(cut(text_statistics(slim, *KEY, "mark1", "mark2"))).where("kept").select(F.col("mark1").alias(a), F.col("mark2").alias(b)).distinct()
    return marked.join(good, [a, b], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
