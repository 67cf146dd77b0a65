"""Mixing sources to target weights by hash-threshold histograms (DataFrame operations only).

Every row gets a hash that is uniform on 0 .. 2**52 - 1.  Tokens are summed by source and the top
bits of the hash; the running sums give, per source, the last threshold that fits the budget and
one boundary bucket.  Only the rows of boundary buckets are summed again, by the next bits, until
the hash is used up.  The mix is then a filter ``hash < threshold``: no row is ever sorted, and a
larger budget keeps every row that a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, staged

#: Weights of the sources in order, repeated; share of all tokens to mix; most repeats of a row.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Bits that one histogram uses, and the histograms over each hash: all 52 bits of ``h``, then 26
#: bits of ``tie`` (rows of equal key and text are alike, so a finer cut between them is not needed).
BITS = 13
WIDTH = 52
LEVELS = {"h": 4, "tie": 2}


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, size``.

    Sources are ordered by code point (null last) and take the weights in turn.  A target stops at
    ``most`` times its source's size; what is over goes to the others by weight.  That level is
    found directly: with sources ordered by cap / weight, the first k are capped, where k is the
    smallest number for which ``(total - caps of k) / weights of the others`` stays under the next
    cap / weight.  One row per source, so the two running sums are over the list of sources.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    pattern = F.array(*[F.lit(int(w)) for w in weights])
    weighed = ranked.withColumn("weight", F.get(pattern, F.col("rank") % len(weights)))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("ratio"), F.col("rank")).rowsBetween(Window.unboundedPreceding, -1)
    levelled = (
        weighed.withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("caps", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("caps")) / F.col("open"))
        .withColumn("_first", F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level")))
        .withColumn("water", F.min("_first").over(everything)["level"])
    )
    target = F.least(F.col("cap").cast("double"), F.coalesce("water", "ratio") * F.col("weight"))
    return levelled.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame, levels: dict[str, int] = LEVELS) -> DataFrame:
    """Per ``source`` of ``budgets`` (``source, budget``) the threshold pair of ``rows``
    (``source, size`` and two 52-bit hashes): a row is in when ``(h, tie) < (t_h, t_tie)``.

    The row on the boundary is taken when that brings the sum closer to the budget.
    """
    hashes = tuple(levels)
    steps = [(h, WIDTH - BITS * (k + 1)) for h in hashes for k in range(levels[h])]
    state = budgets.select(
        "source", F.col("budget").cast("double").alias("room"), *[F.lit(0).cast("long").alias(f"t_{h}") for h in hashes]
    )
    inside = rows
    for h, shift in steps:
        bucket = F.shiftright(F.col(h), shift).bitwiseAND((1 << BITS) - 1)
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("under", F.coalesce(F.sum("size").over(running), F.lit(0)))
        # the first bucket that no longer fits; none: all buckets fit
        edge = (
            sums.join(state.select(F.col("source").alias("s"), "room"), F.col("source").eqNullSafe(F.col("s")))
            .where(F.col("under") + F.col("size") > F.col("room"))
            .groupBy("s")
            .agg(F.min(F.struct("bucket", "under", "size")).alias("edge"))
        )
        joined = state.join(edge, state["source"].eqNullSafe(edge["s"]), "left")
        found, at = F.col("edge").isNotNull(), F.col("edge.bucket")
        room = F.when(found, F.col("room") - F.col("edge.under"))
        if (h, shift) == steps[-1]:
            closer = (F.col("edge.size") - room) < room
            at = at + F.when(closer, 1).otherwise(0)
        step = F.when(found, F.shiftleft(at.cast("long"), shift))
        # a source whose rows all fit leaves the search with a threshold above every hash
        state = joined.select(
            state["source"],
            room.alias("room"),
            *[
                (
                    F.when(F.col(f"t_{x}") >= (1 << 60), F.col(f"t_{x}")).otherwise(
                        F.coalesce(F.col(f"t_{x}") + step, F.lit(1 << 60))
                    )
                    if x == h
                    else F.col(f"t_{x}")
                ).alias(f"t_{x}")
                for x in hashes
            ],
        )
        state = staged(state, "mix-level")
        here = state.where("room is not null").select(
            F.col("source").alias("s"), *[F.col(f"t_{x}").alias(f"e_{x}") for x in hashes]
        )
        on = F.col("source").eqNullSafe(F.col("s"))
        for x in hashes[: hashes.index(h) + 1]:
            known = shift if x == h else 0
            on = on & (F.shiftright(F.col(x), known) == F.shiftright(F.col(f"e_{x}"), known))
        inside = rows.join(here, on, "left_semi")
    return state


def _hash52(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value), 1, 13), 16, 10).cast("long")


def sized_rows(docs: DataFrame, text: str, source: str, key: str, seed: str) -> DataFrame:
    """``docs`` as ``row`` (a struct of all its columns) with ``source, size, h, tie``.

    ``h`` comes from the key and the text, so it does not depend on how the table is cut into
    files; ``tie`` numbers rows and only matters between rows of equal key and text.
    """
    name = F.concat_ws("|", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("?")), F.md5(F.coalesce(F.col(text), F.lit(""))))
    return docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.col(source).alias("source"),
        n_words(F.col(text)).alias("size"),
        _hash52(name).alias("h"),
        F.monotonically_increasing_id().alias("n"),
    ).withColumn("tie", _hash52(F.col("n").cast("string"))).drop("n")


def mix_sources(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    keep: tuple[str, ...] | None = None,
    weights=WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: str = "mix",
) -> DataFrame:
    """Decide how often each row of ``docs`` enters the mix.

    Returns ``row`` (struct of the columns ``keep``, all by default), ``size`` (words), ``source``,
    ``source_size``, ``target``, ``times`` (int, 0 to ``most``) and ``taken = times * size``.

    Null text counts 0 words (and never changes a sum); a null source is a source of its own, last
    in order; null or repeated keys are allowed; identical rows are told apart by a row number; an
    empty table gives an empty result.  Extra columns travel inside ``row``, so their names cannot
    clash.
    """
    chosen = docs.select(*keep) if keep else docs
    needed = docs.select(*dict.fromkeys([*chosen.columns, text, source, key]))
    rows = sized_rows(needed, text, source, key, seed)
    if keep:
        rows = rows.withColumn("row", F.struct(*[F.col("row")[c].alias(c) for c in keep]))
    rows = staged(rows, "mix-rows")
    sized = rows.select("source", "size", "h", "tie")
    targets = staged(source_targets(sized, weights, share, most), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budgets = targets.select("source", (F.col("target") - whole * F.col("source_size")).alias("budget"))
    limits = thresholds(sized.where("size > 0"), budgets)
    facts = (
        targets.join(limits.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
        .select(F.col("source").alias("s"), "source_size", "target", whole.cast("int").alias("whole"), "t_h", "t_tie")
    )
    below = (F.col("h") < F.col("t_h")) | ((F.col("h") == F.col("t_h")) & (F.col("tie") < F.col("t_tie")))
    extra = F.when((F.col("whole") < most) & (F.col("size") > 0) & below, 1).otherwise(0)
    return (
        rows.join(facts, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("times", (F.col("whole") + extra).cast("int"))
        .select("row", "size", "source", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it."""
    decided = mix_sources(docs, **options).where("times > 0")
    repeated = decided.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return repeated.select("row.*")
