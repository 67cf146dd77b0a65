"""Best-fit packing into sequences of several permitted lengths, chosen jointly.

Documents are cut at the largest permitted length, the pieces are dealt into groups of bounded
size, and every group is packed on its own.  A sequence costs an overhead, its length and a share of its length's square,
so the best length depends on what will fill it.  Pieces in falling length go to the fullest open bin that holds
them; else a bin is opened whose cost, less what its free room is worth, is least.  What a word of room is worth
follows from the lengths together: a group is packed under the price of each permitted length (its cost per word when full) and under none,
and the cheapest packing is kept.  Its bins are then packed as if they were pieces, for as long as
that makes it cheaper, and at the end each bin shrinks to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_words, staged

#: Permitted sequence lengths, in words.
CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a sequence of length c: OVERHEAD + c + QUADRATIC * c * c (attention grows with the square).
OVERHEAD = 96
QUADRATIC = 1 / 16384
#: Pieces that one group holds on average: the memory of one packing task.
GROUP_PIECES = 20_000


def sequence_cost(capacity):
    return OVERHEAD + capacity + QUADRATIC * capacity * capacity


def opening_capacity(length: int, smaller: int, capacities=CAPACITIES, price: float = 0.0, piece: float = 1.0) -> int:
    """The permitted capacity for a bin that starts with a piece of ``length``: least cost, less ``price`` for every word
    of free room that the ``smaller`` words still to come, in shorter pieces of ``piece`` words on average, would fill;
    ties: the smaller one."""
    fit = [c for c in capacities if c >= length]
    filled = lambda c: min(smaller, (c - length) // piece * piece)
    return min(fit, key=lambda c: (sequence_cost(c) - price * filled(c), c))


def best_fit(lengths: np.ndarray, capacities=CAPACITIES, price: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin number and offset for each length (0 < length <= largest), and the words in each bin.

    Open bins are listed by free room; one bit per room says whether any bin has it, so the best
    fit is the lowest set bit from the piece's length on.
    """
    n, top = len(lengths), max(capacities)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    by_room: list[list[int]] = [[] for _ in range(top + 1)]
    mask, used = 0, []
    left = int(lengths.sum())
    for turn, i in enumerate(np.argsort(-lengths, kind="stable").tolist(), 1):
        size = int(lengths[i])
        left -= size
        rooms = mask >> size
        if rooms:
            room = size + (rooms & -rooms).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            room = opening_capacity(size, left, capacities, price, left / max(n - turn, 1) or 1.0)
            b = len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        room -= size
        if room:
            by_room[room].append(b)
            mask |= 1 << room
    return bins, offsets, np.asarray(used, np.int64)


def downsized(used: np.ndarray, capacities=CAPACITIES) -> np.ndarray:
    """The smallest permitted capacity that holds each bin's words."""
    sizes = np.asarray(sorted(capacities))
    return sizes[np.searchsorted(sizes, used)]


def cheapest(lengths: np.ndarray, capacities=CAPACITIES) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Of the packings under all prices the one whose downsized bins cost least (ties: the first)."""
    found = None
    for price in [0.0, *sorted({sequence_cost(c) / c for c in capacities})]:
        bins, offsets, used = best_fit(lengths, capacities, price)
        cost = float(sequence_cost(downsized(used, capacities)).sum())
        if found is None or cost < found[0]:
            found = cost, bins, offsets, used
    return found


def pack(lengths: np.ndarray, capacities=CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin number, offset in the bin and final capacity for each length (0 < length <= largest)."""
    if not len(lengths):
        return (np.zeros(0, np.int64),) * 3
    cost, bins, offsets, used = cheapest(lengths, capacities)
    while True:
        # whole bins as pieces: two that are half empty may cost less as one
        less, outer, at, together = cheapest(used, capacities)
        if less >= cost:
            break
        cost, bins, offsets, used = less, outer[bins], at[bins] + offsets, together
    return bins, offsets, downsized(used, capacities)[bins]


def pack_documents(
    docs: DataFrame, text: str = "text", capacities=CAPACITIES, group_pieces: int = GROUP_PIECES, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Place every word of every document into a sequence.

    Returns one row per piece: ``row`` (struct of the columns ``keep``), ``piece`` (number of the
    piece in its document), ``first_word`` and ``n_words`` (the words ``first_word ..`` of the
    document), ``bin`` (string, unique), ``start`` (offset in the bin), ``capacity`` and ``used``
    of the bin.  Pieces of a bin do not overlap and ``used <= capacity``.

    A text without words (null or empty) has no piece.  A document longer than the largest capacity
    is cut into pieces of that capacity and a rest.  Groups are dealt by a hash of a row number, so
    equal keys or texts, however many, spread evenly; nothing depends on column names but those
    given.  An empty table gives an empty result.
    """
    top = max(capacities)
    sized = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), n_words(F.col(text)).alias("n"))
    sized = staged(sized.where("n > 0").withColumn("id", F.monotonically_increasing_id()), "pack-sizes")
    pieces = sized.agg(F.sum(F.ceil(F.col("n") / top))).first()[0] or 0
    groups = max(1, -(-int(pieces) // group_pieces))
    cut = (
        sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / top))))
        .withColumn("first_word", F.col("piece") * top)
        .withColumn("n_words", F.least(F.lit(top).cast("long"), F.col("n") - F.col("first_word")))
        .withColumn("group", F.pmod(F.xxhash64("id", "piece"), F.lit(groups)).cast("int"))
    )

    def pack_group(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_words", "id", "piece"], ascending=[False, True, True], kind="stable")
        bins, starts, capacity = pack(part["n_words"].to_numpy(), capacities)
        used = np.bincount(bins, weights=part["n_words"].to_numpy()).astype(np.int64)
        return pd.DataFrame(
            {
                "id": part["id"].to_numpy(),
                "piece": part["piece"].to_numpy(),
                "first_word": part["first_word"].to_numpy(),
                "n_words": part["n_words"].to_numpy(),
                "bin": [f"{key[0]}-{b}" for b in bins],
                "start": starts,
                "capacity": capacity,
                "used": used[bins],
            }
        )

    packed = (
        cut.select("id", "piece", "first_word", "n_words", "group")
        .groupBy("group")
        .applyInPandas(
            pack_group,
            "id long, piece long, first_word long, n_words long, bin string, start long, capacity long, used long",
        )
    )
    return packed.join(sized.select("id", "row"), "id").drop("id")
