"""Document fingerprints by winnowing word k-grams."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, fresh, small, words

#: Words in a gram and grams in a window: runs of K + W - 1 equal words always share a fingerprint.
K, W = 4, 8
#: Low bits that hold a gram's place: a text of 2 GB, the longest there is, has at most 2 ** 30 words.
PLACE = 30
#: The rolling hash: a polynomial in BASE over word hashes, modulo the greatest prime under 2 ** 33, so that no product leaves 63 bits.
PRIME, BASE = (1 << 33) - 9, 479_001_599
#: Parts of a group of bucket bounds, and buckets at most.
GROUP, BUCKETS = 256, 1 << 16
MASK = (1 << PLACE) - 1


def word_hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME)))


def grams(hashed: Column, k: int = K) -> Column:
    """Gram hashes with their places below: hash bits above, the place counted down below, so that the least value is the least hash and, among equals, the rightmost.

    `hashed` is a column of word_hashes, so that every word is hashed once. A gram's hash is the rolling polynomial ((w0 * B + w1) * B + ..) mod P over those hashes; SQL
    arrays have no scan, so each gram's value is summed from its k word hashes instead of from the gram before."""
    n = F.size(hashed)

    def roll(parts: list[Column]) -> Column:
        out = parts[0]
        for x in parts[1:]:
            out = F.pmod(out * BASE + x, F.lit(PRIME))
        return out

    whole = F.array(F.aggregate(hashed, F.lit(0).cast("long"), lambda a, x: F.pmod(a * BASE + x, F.lit(PRIME))))
    hashes = F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: roll([F.get(hashed, i + j) for j in range(k)]))).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))
    return F.transform(hashes, lambda h, i: F.shiftleft(h, PLACE).bitwiseOR(F.lit(MASK) - i.cast("long")))


def select(values: Column, w: int = W) -> Column:
    """The least value of every window of w, each once, left to right; a shorter array is one window."""
    n = F.size(values)
    last = F.greatest(n - w + 1, F.lit(1))
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda s: F.array_min(F.slice(values, s, F.lit(w)))))).otherwise(values)


def fingerprint(selected: Column) -> Column:
    """`place:hash` of every selected gram."""
    return F.array_join(F.transform(selected, lambda v: F.concat((F.lit(MASK) - v.bitwiseAND(F.lit(MASK))).cast("string"), F.lit(":"), F.hex(F.shiftrightunsigned(v, PLACE)))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the gram hashes; two empty fingerprints are alike."""
    x, y = (F.transform(c, lambda v: F.shiftrightunsigned(v, PLACE)) for c in (a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """docs(doc_id, text) plus `selected`, the chosen grams with places; null and empty texts choose none, texts of under k words one.

    A column `selected` in docs is replaced, all others stay; an empty table gives an empty one, repeated rows repeat."""
    docs = docs.drop("selected")
    hs, gs = fresh(docs, "hashes", "grams")
    # One step a column, or the hashes would be taken once for every use of them.
    df = docs.withColumn(hs, word_hashes(words(F.col("text")))).withColumn(gs, grams(F.col(hs), k))
    return df.withColumn("selected", select(F.col(gs), w)).drop(hs, gs)


def with_next(docs: DataFrame, rows_per_bucket: int = 4000) -> tuple[DataFrame, Window]:
    """docs(doc_id, text) plus bucket, helper and tie, dealt so that every row's successor by doc_id shares its bucket.

    Buckets are ranges between quantiles of (id, hash of the text), so neither clustered ids nor many rows of one id or
    without an id fill one. Quantiles are approximate, what lies between them is not. The first row of each bucket is also
    sent, as a helper, to the bucket before (the very first to the last). Equal ids follow each other by the text's hash;
    null ids come first; equal rows share a bucket."""
    ids = docs.select("doc_id", F.xxhash64("text").alias("tie"))
    span = ids.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo")).first()
    buckets = max(1, min(BUCKETS, -(-span["n"] // rows_per_bucket)))
    # The id counts from the least, so that doubles keep the hash apart as long as ids allow it; both parts only ever raise it.
    key = F.coalesce(F.col("doc_id").cast("double") - float(span["lo"] or 0) + 1, F.lit(0.0)) * float(1 << 62) + (F.col("tie").cast("double") / 4 + float(1 << 61))
    bounds = []
    if buckets > 1:
        shares = F.lit([i / buckets for i in range(1, buckets)])
        bounds = sorted(set(ids.agg(F.percentile_approx(key, shares, 10 * buckets)).first()[0]))
    groups = [bounds[i : i + GROUP] for i in range(0, len(bounds), GROUP)]
    if groups:
        table = F.from_json(F.lit(json.dumps(groups)), "array<array<double>>")
        at = F.greatest(F.size(F.filter(F.transform(table, lambda g: g[0]), lambda b: b <= key)), F.lit(1))
        bucket = ((at - 1) * GROUP + F.size(F.filter(F.element_at(table, at), lambda b: b <= key))).cast("long")
    else:
        bucket = F.lit(0).cast("long")
    first = ids.groupBy(bucket.alias("bucket")).agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "tie")).alias("first"))
    order = Window.orderBy("bucket")  # at most `buckets` rows
    last = first.agg(F.max("bucket").alias("last"))
    first = cut(first.withColumn("before", F.lag("bucket").over(order)).join(F.broadcast(last)).select("bucket", "first", F.coalesce("before", "last").alias("before")))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).withColumn("bucket", bucket).join(small(first), "bucket")
    is_first = (F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("first.id")) & (F.col("tie") == F.col("first.tie"))
    here = F.struct(F.col("bucket"), F.lit(0).alias("helper"))
    there = F.struct(F.col("before").alias("bucket"), F.lit(1).alias("helper"))
    rows = rows.select("doc_id", "text", "tie", F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here))).alias("to")).select("doc_id", "text", "tie", "to.bucket", "to.helper")
    return rows, Window.partitionBy("bucket").orderBy("helper", F.asc_nulls_first("doc_id"), "tie")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """The contract's columns: each text's fingerprint beside that of the text whose second half is the next document's head. Texts move once.

    Null texts are empty; a lone row is its own next; an empty table gives an empty one; other columns of docs are left out."""
    rows, order = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    rows = fingerprints(rows.withColumn("_next", F.lead("text").over(order))).withColumnRenamed("selected", "own")
    rows = rows.withColumn("_next_own", F.lead("own").over(order)).where("helper = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("_next"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "own", "_next_own", edited.alias("text"))
    rows = fingerprints(rows).withColumnRenamed("selected", "changed")
    return rows.select("doc_id", "n_chars", F.sha2("text", 256).alias("edited_sha256"), fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("_next_own")).alias("near_next"))
