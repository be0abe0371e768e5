"""Column expressions used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, digits: int) -> Column:
    """Round half away from zero on the scaled double, as SQL engines do: `F.round` on the decimal text of a double settles ties such as 64.2028125 otherwise."""
    x, scale = c.cast("double"), float(10**digits)
    return F.when(F.abs(x) < 1e300 / scale, F.round(x * scale) / scale).otherwise(x)


def r6(c: Column) -> Column:
    """Six decimals, never a negative zero."""
    return rounded(c, 6) + F.lit(0.0)


def r96(c: Column) -> Column:
    """Nine decimals, then six: for means of cents, whose ties must not hang on the order of a sum."""
    return r6(rounded(c, 9))


def draw(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) fixed by seed and keys, the first 13 hexadecimal digits of an MD5: any engine can repeat it, and so do retries."""
    h = F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("~")) for k in keys]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def cents(c: Column) -> Column:
    """Round half away from zero on the scaled value."""
    return F.round(c * 100) / 100


def local_hour(ts: Column, tz: str) -> Column:
    return F.hour(F.from_utc_timestamp(ts.cast("timestamp"), tz))


def local_dow(ts: Column, tz: str) -> Column:
    """0 is Sunday."""
    return F.dayofweek(F.from_utc_timestamp(ts.cast("timestamp"), tz)) - 1


def entropy(items: str) -> str:
    """SQL text: entropy in nats of the amount shares of array<struct<purpose,amount>> `items`; 0 without a positive total."""
    sums = purpose_sums(items)
    return f"""coalesce(aggregate({sums}, named_struct('s', 0D, 'q', 0D),
        (a, x) -> named_struct('s', a.s + x, 'q', a.q + if(x > 0, x * ln(x), 0D)),
        a -> if(a.s > 0, ln(a.s) - a.q / a.s, 0D)), 0D)"""


def purpose_sums(items: str) -> str:
    return f"""transform(array_distinct(transform({items}, i -> i.purpose)),
        p -> aggregate({items}, 0D, (a, i) -> a + if(i.purpose <=> p, i.amount, 0D)))"""


def pareto_inverse(u: Column, minimum: Column, alpha: Column) -> Column:
    """Inverse survival function: minimum * (1 - u) ** (-1 / alpha)."""
    return minimum * F.pow(1 - u, -1 / alpha)


def weighted_choice(u: Column, values: Column, cdf: Column) -> Column:
    """The first value whose cumulative weight exceeds u times the total."""
    target = u * F.element_at(cdf, -1)
    return F.element_at(values, F.least(F.size(F.filter(cdf, lambda c: c <= target)) + 1, F.size(values)).cast("int"))


def category_weights(m: Column, floor: float = 0.0001) -> Column:
    """Map of value to weight out of a profile category: `_metadata` skipped, unreadable or tiny weights floored, `unknown` for nothing."""
    kept = F.map_filter(m, lambda k, v: k != "_metadata")
    weights = F.transform_values(kept, lambda k, v: F.greatest(F.coalesce(v["prob"].try_cast("double"), F.lit(0.0)), F.lit(floor)))
    return F.when(m.isNotNull() & (F.size(kept) > 0), weights).otherwise(F.create_map(F.lit("unknown"), F.lit(1.0)))


def slug(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))
