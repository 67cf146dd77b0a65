"""Fold assignment and sampling: W2 (author-disjoint contiguous folds), V1 (stratified folds),
M7 (fixed-size sample per class), P14 (history band)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .prefix import exclusive_sums, keyed_exclusive_sum


_MIX = 2654435761
_TWO32 = 4294967296


def mix_hash(c) -> Column:
    """A cheap deterministic integer mix in [0, 2^32): (id · 2654435761) mod 2^32 — plain
    arithmetic, so any SQL engine computes the same value.  The id is reduced mod 2^32 and split
    in 16-bit halves first, so no intermediate product leaves the long range (ANSI mode raises on
    overflow) whatever the id."""
    x = F.pmod((F.col(c) if isinstance(c, str) else c).cast("long"), F.lit(_TWO32))
    hi = F.floor(x / F.lit(65536)).cast("long")
    lo = F.pmod(x, F.lit(65536))
    hi_part = F.pmod(F.pmod(hi * F.lit(_MIX), F.lit(_TWO32)) * F.lit(65536), F.lit(_TWO32))
    return F.pmod(hi_part + lo * F.lit(_MIX), F.lit(_TWO32))


def history_band(df: DataFrame, col: str, down: float, up: float) -> DataFrame:
    """Rows with ``down <= col <= up`` (closed at both ends, so a band edge row is in two
    bands, Q18)."""
    return df.where(F.col(col).between(F.lit(down), F.lit(up)))


def author_folds(df: DataFrame, author: str, k: int, out: str = "group_number") -> DataFrame:
    """Contiguous author-disjoint folds.

    Rows are taken in author order (so a run of rows is one author).  Fold i takes whole authors
    until it holds at least n/k rows; the next author opens fold i+1.  Rows without an author are the first run.  Plan:
    per-author counts (map-side combined) → global exclusive prefix sum of the counts in author
    order (skew-proof scan, no single-partition window) → at most k "next start" steps, each a
    ``min`` over the author table → fold of an author = number of fold starts at or before its
    offset, minus one → equi-join back to the rows.
    """
    runs = df.groupBy(author).agg(F.count(F.lit(1)).alias("__xc_n")).withColumn("__xc_all", F.lit(0))
    offsets = exclusive_sums(runs, ["__xc_all"], [author], ["__xc_n"], suffix="_start")
    offsets = staged(offsets.select(author, "__xc_n", F.col("__xc_n_start").alias("__xc_start")), "author-offsets")
    total = offsets.agg(F.sum("__xc_n")).first()[0] or 0
    step = total / float(k)
    starts = [0]
    while True:
        nxt = offsets.where(F.col("__xc_start") >= F.lit(starts[-1] + step)).agg(F.min("__xc_start")).first()[0]
        if nxt is None:
            break
        starts.append(int(nxt))
    fold = sum((F.when(F.col("__xc_start") >= F.lit(s), 1).otherwise(0) for s in starts), F.lit(0)) - F.lit(1)
    folds = offsets.select(F.col(author).alias("__xc_author"), fold.cast("int").alias(out))
    return df.join(folds, F.col(author).eqNullSafe(F.col("__xc_author"))).drop("__xc_author")


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int, out: str = "fold") -> DataFrame:
    """V1: exact stratified k folds.  Inside each class rows are ranked by (mix_hash(id), id) and
    dealt round-robin: fold = rank mod k.  The rank is a keyed running count (skew-proof scan), so
    a class holding most rows is still split over many tasks."""
    x = df.withColumn("__xc_h", mix_hash(id_col)).withColumn("__xc_one", F.lit(1))
    # the hash has 32 bits: 2**18 ranges of each class, whatever its size
    ranked = keyed_exclusive_sum(x, [label], ["__xc_h", id_col], ["__xc_one"], suffix="_rank", cut=F.shiftright("__xc_h", 14))
    return ranked.withColumn(out, F.pmod(F.col("__xc_one_rank"), F.lit(k)).cast("int")).drop(
        "__xc_h", "__xc_one", "__xc_one_rank")


def class_sample(df: DataFrame, label: str, id_col: str, sizes: dict) -> DataFrame:
    """M7: exactly ``sizes[c]`` rows (or all, if fewer) of each class c, chosen by the smallest
    (mix_hash(id), id).  One top-k per class (partial top-k in every partition, then a merge of
    k rows per partition), then a union — no class is ever gathered into one task."""
    parts = []
    for value, n in sorted(sizes.items()):
        c = df.where(F.col(label) == F.lit(value)).withColumn("__xc_h", mix_hash(id_col))
        parts.append(c.orderBy("__xc_h", id_col).limit(int(n)).drop("__xc_h"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
