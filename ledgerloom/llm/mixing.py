"""Mixing sources to target weights: temperature on token shares, then budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, fresh, small, word_count


def key_hash(seed: int, *cols: Column) -> Column:
    """32 hexadecimal digits fixed by seed and values; nulls count as a value of their own."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols]))


def uniform(h: Column) -> Column:
    """[0, 1) from the first 13 digits."""
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def source_tokens(docs: DataFrame, tokens: Column) -> DataFrame:
    """(source, n_docs, tokens); a null source is `unknown`."""
    return docs.select(F.coalesce(F.col("source").cast("string"), F.lit("unknown")).alias("source"), tokens.alias("n")).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("tokens"))


def _exponent(live: DataFrame, s, entropy: float | None, repetition: float | None, budget: float | None, points: int = 32, passes: int = 7) -> float:
    """The greatest exponent, to nine decimals, at which the target is still met; the target is met the better the smaller the exponent.

    Repetition without a budget hangs on the least and the greatest source alone and is bisected. Otherwise each pass sums
    `points` exponents between the last that met the target and the first that did not, in one aggregate over the sources."""
    share = F.col("tokens") / s["total"]
    if entropy is None and budget is None:
        enough = lambda es: [(s["lo"] / s["hi"]) ** (e - 1) >= repetition for e in es]
        points, passes = 1, 50
    else:
        def enough(es):
            cols = [x for i, e in enumerate(es) for x in (F.sum(F.pow(share, F.lit(e))).alias(f"z{i}"), F.sum(F.pow(share, F.lit(e)) * e * F.ln(share)).alias(f"q{i}"))]
            r = live.agg(*cols).first()
            if entropy is not None:
                return [math.log(r[f"z{i}"]) - r[f"q{i}"] / r[f"z{i}"] >= entropy * math.log(s["k"]) for i in range(len(es))]
            return [budget * s["total"] * (s["lo"] / s["total"]) ** e / (r[f"z{i}"] * s["lo"]) >= repetition for i, e in enumerate(es)]

    if entropy is not None and (s["k"] < 2 or enough([1.0])[0]):
        return 1.0
    if entropy is None and (s["k"] < 2 or (s["hi"] / s["lo"] <= repetition if budget is None else not enough([0.0])[0])):
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(passes):
        es = [lo + (hi - lo) * (i + 1) / (points + 1) for i in range(points)]
        met = enough(es)
        k = next((i for i, m in enumerate(met) if not m), points)
        lo, hi = ([lo, *es][k], [*es, hi][k])
    # Entropy must be met; repetition must not be passed.
    return round(lo if entropy is not None else hi, 9)


def solve(sources: DataFrame, *, entropy: float | None, repetition: float | None, budget: float | None) -> DataFrame:
    """sources plus weight, exponent and epochs.

    Weights are shares ** exponent, normalised. The exponent falls from 1 towards 0 until the entropy of the weights reaches
    `entropy` of the most that the sources allow, or as far as no source is read more than `repetition` times. The budget is
    `budget` times all tokens; None takes the least budget that reads every document once. Sources without tokens get
    weight 0 and one epoch. Sources are only ever aggregated, so there may be any number of them."""
    live = sources.where("tokens > 0")
    s = live.agg(F.min("tokens").alias("lo"), F.max("tokens").alias("hi"), F.sum("tokens").cast("double").alias("total"), F.count(F.lit(1)).alias("k")).first()
    if not s["k"]:
        return sources.select("source", "n_docs", "tokens", F.lit(1.0).alias("exponent"), F.lit(0.0).alias("weight"), F.lit(1.0).alias("epochs"))
    x = _exponent(live, s, entropy, repetition, budget)
    powered = F.pow(F.col("tokens") / s["total"], F.lit(x))
    sums = live.agg(F.sum(powered).alias("z"), F.max(F.col("tokens") / powered).alias("most"))
    spend = F.lit(budget * s["total"]) if budget is not None else F.col("most") * F.col("z")
    some = F.col("tokens") > 0
    return sources.join(F.broadcast(sums)).select("source", "n_docs", "tokens", F.lit(x).alias("exponent"),
        F.when(some, F.round(powered / F.col("z"), 9)).otherwise(0.0).alias("weight"),
        F.when(some, F.round(spend * powered / F.col("z") / F.col("tokens"), 6)).otherwise(1.0).alias("epochs"))


def mix(docs: DataFrame, *, entropy: float | None = None, repetition: float | None = 1.25, budget: float | None = None, tokens: Column | None = None, seed: int = 42, block_docs: int = 256) -> DataFrame:
    """docs, each row as often as its source is read, with source_weight, n_tokens, epoch, block and block_position.

    A source read 2.4 times gives two whole passes and, in a third, 0.4 of the tokens of every block. A block is some
    `block_docs` rows of a source that share a hash; each pass permutes each block anew by hash, and the last pass keeps the
    rows whose midpoint of running tokens is within the block's budget. Blocks bound every sort and window, so a source may
    hold any share of the rows. Without a budget every document is read at least once. Rows are told apart by doc_id, then by
    text: equal rows are ordered arbitrarily among themselves, which changes no content. Null and empty texts weigh nothing
    and pass while the block has budget left. Columns of those names in docs are replaced."""
    docs = docs.drop("source_weight", "n_tokens", "epoch", "block", "block_position")
    src, blocks, epochs, h, cum, every = fresh(docs, "src", "blocks", "epochs", "h", "cum", "every")
    tokens = word_count(F.col("text")) if tokens is None else tokens
    plan = solve(cut(source_tokens(docs, tokens)), entropy=entropy, repetition=repetition, budget=budget)
    plan = small(cut(plan).select(F.col("source").alias(src), F.col("weight").alias("source_weight"), F.col("epochs").alias(epochs), F.greatest(F.ceil(F.col("n_docs") / block_docs), F.lit(1)).alias(blocks)))
    keyed = docs.withColumns({"n_tokens": tokens, src: F.coalesce(F.col("source").cast("string"), F.lit("unknown")), h: key_hash(seed, F.col("doc_id"))})
    placed = keyed.join(plan, src).withColumn("block", F.floor(uniform(F.col(h)) * F.col(blocks)))
    passes = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(epochs) - 1, F.lit(0)).cast("int")))).withColumn(h, F.md5(F.concat(F.col(h), F.lit("/"), F.col("epoch").cast("string"))))
    block = Window.partitionBy(src, "epoch", "block")
    ordered = block.orderBy(h, "n_tokens", *([F.xxhash64("text")] if "text" in docs.columns else []))
    placed = passes.withColumns({
        cum: F.sum("n_tokens").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "block_position": F.row_number().over(ordered),
        every: F.sum("n_tokens").over(block),
    })
    part = F.col(epochs) - F.col("epoch")
    kept = placed.where((part >= 1) | (F.col(cum) - F.col("n_tokens") / 2 <= part * F.col(every)))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns], "source_weight", "n_tokens", F.col("epoch").cast("long").alias("epoch"), F.col("block").cast("long").alias("block"), F.col("block_position").cast("long").alias("block_position"))
