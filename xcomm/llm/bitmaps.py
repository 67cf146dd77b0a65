"""Bit maps of fixed size in front of passes and joins: every wanted id passes, and few others."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a map: 8 MB, whatever the input.
MAP_BITS = 26


class BitMap:
    """A map that travels compressed to the tasks: an almost empty one costs next to nothing."""

    def __init__(self, words: np.ndarray):
        self.packed, self.words = zlib.compress(words.tobytes(), 1), words

    def __getstate__(self):
        return {"packed": self.packed, "words": None}

    def has(self, ids: np.ndarray) -> np.ndarray:
        """Whether the bits of ``ids`` (uint64) are set."""
        if self.words is None:
            self.words = np.frombuffer(zlib.decompress(self.packed), np.uint64)
        bit = ids & np.uint64((1 << MAP_BITS) - 1)
        return (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def bit_map(ids: DataFrame) -> BitMap:
    """The map of the 64-bit ids in column ``id``; at most 2**20 words reach the driver."""
    bit = F.col("id").bitwiseAND((1 << MAP_BITS) - 1)
    word = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
    cells = (
        ids.select(F.shiftright(bit, 6).cast("int").alias("cell"), word.alias("bits"))
        .groupBy("cell")
        .agg(F.bit_or("bits").alias("bits"))
        .toArrow()
    )
    table = np.zeros(1 << (MAP_BITS - 6), np.int64)
    table[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return BitMap(table.view(np.uint64))


def without_ids(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` is not among the ids in column ``gone`` of ``gone``.

    Rows whose bit is not set pass without a shuffle; the others, the ids that go and few more,
    are held against the list by an anti-join.  Null keys stay."""
    ids = gone.distinct()
    table = bit_map(ids.select(F.xxhash64("gone").alias("id")))

    def has(hashes: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in hashes:
            yield pa.array(table.has(column.to_numpy(zero_copy_only=False).view(np.uint64)))

    listed = F.arrow_udf(has, T.BooleanType())(F.xxhash64(df[key]))
    return df.where(~listed).union(df.where(listed).join(ids, df[key] == ids["gone"], "left_anti"))
