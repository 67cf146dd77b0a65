"""Keyed running sums without a task per key.

``Window.partitionBy(key).orderBy(t)`` over rows puts every row of a key into one task.  Here rows
are first summed per (key, order value), so ties and repeated rows collapse on the map side.  The order
is cut into ranges by a monotone image of it; a window runs inside each (key, range) over one row per order
value, and a second one over the ranges' totals of a key.  The sum before a row is that before its range plus that
inside it: two shuffles of the summed rows, one of a row per (key, range), one join on (key, range).

Ranges: 64-bit integers are cut at bit 24 (ten years are 19 ranges of 194 days in seconds and 19 million
ranges of 17 seconds in microseconds, so in either unit no window of one key sees more than some 20
million rows, however many rows the key has), floating numbers by magnitude, dates by 256 days, timestamps like
integers of microseconds.  Texts and other types are cut at sampled quantiles of their distinct values, so a prefix that all
share does no harm; the sample is one small job when the plan is built.  A caller that knows its order gives its own
cut.  Everything is native, exact for all 64-bit values and the same at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RANGE = "__xc_range"
_LONGS = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
#: Bit at which an integer order is cut.
_CUT = 24
#: Values sampled for quantiles, and ranges cut from them.
SAMPLE, RANGES = 4096, 256


def quantile_cut(df: DataFrame, col: str, sample: int = SAMPLE, ranges: int = RANGES) -> Column:
    """A monotone image of ``col``: the number of its range among ``ranges`` of about as many distinct values each.

    The bounds come from ``sample`` distinct values, chosen by hash (a top-k job), and are literals of the
    expression; nulls are a range of their own, before all others."""
    values = df.select(F.col(col).alias("v")).where("v is not null").distinct()
    rows = values.orderBy(F.xxhash64("v"), "v").limit(sample).collect()
    kind = df.schema[col].dataType
    ordered = sorted((r["v"] for r in rows), key=lambda v: v.encode("utf-8", "surrogatepass") if isinstance(v, str) else v)
    bounds = sorted({len(ordered) * i // ranges for i in range(1, ranges)} - {0})

    def among(low: int, high: int) -> Column:
        """Range number of values between two bounds: a balanced tree of comparisons."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(col) < F.lit(ordered[bounds[middle]]).cast(kind), among(low, middle)).otherwise(among(middle + 1, high))

    return F.when(F.col(col).isNull(), F.lit(-1)).otherwise(among(0, len(bounds)))


def order_range(df: DataFrame, col: str) -> Column:
    """The range that a value of ``col`` lies in: a monotone image by its type."""
    kind, c = df.schema[col].dataType, F.col(col)
    if isinstance(kind, _LONGS):
        return F.shiftright(c.cast("long"), _CUT)
    if isinstance(kind, T.DateType):
        return F.shiftright(F.unix_date(c), 8)
    if isinstance(kind, T.TimestampType):
        return F.shiftright(F.unix_micros(c), _CUT)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.floor(F.signum(c) * F.log1p(F.abs(c)) * 4096)
    return quantile_cut(df, col)


def exclusive_sums(totals: DataFrame, keys: list[str], order: list[str], weights: list[str], suffix: str = "_before", cut: Column | None = None) -> DataFrame:
    """``totals`` (one row per keys and order) with ``<w><suffix>``: the sum of ``w`` over rows of the same keys that
    sort strictly earlier.  ``cut``: a monotone image of ``order[0]``; by default it follows from its type."""
    before = [f"{w}{suffix}" for w in weights]
    inside = [*keys, _RANGE]
    table = totals.withColumn(_RANGE, order_range(totals, order[0]) if cut is None else cut)

    def running(x: DataFrame, by: list[str], along: list[str], names: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*along).rowsBetween(Window.unboundedPreceding, -1)
        return x.withColumns({b: F.coalesce(F.sum(v).over(w), F.lit(0)) for b, v in zip(names, weights, strict=True)})

    started = [f"__xc_start_{w}" for w in weights]
    ranges = running(table.groupBy(*inside).agg(*[F.sum(w).alias(w) for w in weights]), keys, [_RANGE], started)
    ranges = ranges.select(*[F.col(c).alias(f"__xc_r_{c}") for c in inside], *started)
    match = F.lit(True)
    for c in inside:
        match = match & F.col(c).eqNullSafe(F.col(f"__xc_r_{c}"))
    joined = running(table, inside, order, before).join(ranges, match)
    values = [(F.col(b) + F.col(s)).alias(b) for b, s in zip(before, started, strict=True)]
    return joined.select(*[F.col(c) for c in totals.columns], *values)


def keyed_exclusive_sum(
    df: DataFrame, keys: list[str], order: list[str], weights: list[str], suffix: str = "_before", cut: Column | None = None
) -> DataFrame:
    """For every row add ``<w><suffix>`` = sum of ``w`` over rows with the same ``keys`` that sort
    strictly earlier by ``order``; rows equal on ``keys + order`` get the same sum.

    Weights must be integral or floating columns; nulls count as 0.  A null key is a key of its
    own; nulls in the order sort first."""
    spine = [*keys, *order]
    totals = df.groupBy(*spine).agg(*[F.sum(F.coalesce(F.col(w), F.lit(0))).alias(w) for w in weights])
    before = [f"{w}{suffix}" for w in weights]
    sums = exclusive_sums(totals, keys, order, weights, suffix, cut)
    right = sums.select(*[F.col(c).alias(f"__xc_s_{c}") for c in spine], *before)
    match = F.lit(True)
    for c in spine:
        match = match & F.col(c).eqNullSafe(F.col(f"__xc_s_{c}"))
    return df.join(right, match).select(*[df[c] for c in df.columns], *before)
