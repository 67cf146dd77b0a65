"""Two-pass external shuffle into shards.

Pass 1 scatters rows by a seeded hash into buckets that fit in a task's memory, pass 2 permutes
each bucket with a seeded Fisher-Yates shuffle and writes it.  A row's place is its bucket's offset
in the shard plus its position in the bucket; offsets come from the written files' counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import fresh_folder

SHARDS = 8
#: Bytes of text that one bucket may hold on average.
BUCKET_BYTES = 32 << 20


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """Rendezvous hashing: the shard whose hash with the key is largest.  The key and the number of
    shards alone decide, and a further shard only takes keys, it moves none between old ones.  A
    null key is a key like any other."""
    scores = [F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("score"), F.lit(i).alias("shard")) for i in range(shards)]
    return F.greatest(*scores)["shard"] if shards > 1 else F.lit(0)


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A permutation of 0 .. n - 1: for i from the end, swap i with a random place up to i."""
    rng = np.random.default_rng(seed)
    place = np.arange(n)
    picks = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64)
    order = place.tolist()
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return np.asarray(order, dtype=np.int64)


def shuffle_into_shards(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shards: int = SHARDS,
    seed: int = 7,
    bucket_bytes: int = BUCKET_BYTES,
    path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Write ``docs`` in shuffled order, as folders ``shard=i/bucket=j`` under ``path``.

    Returns the written rows (``row``: struct of all columns, ``shard``, ``bucket``, ``pos``) and
    the manifest ``shard, bucket, n_rows, first_slot``; ``first_slot + pos`` is the row's place in
    its shard, gapless from 0.

    The shard follows from the key (rendezvous hashing).  Within a shard the bucket also hashes the
    text and the input partition, so a key or a text that many rows share is spread over buckets
    and no bucket grows with it beyond one input partition's share.  Rows of equal hash differ in
    nothing but position.  Null keys share one shard; null and empty texts are written as they are;
    an empty table writes nothing and returns two empty frames; extra columns travel in ``row``.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    spread = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key), F.col(text), F.spark_partition_id()), F.lit(buckets))
    placed = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        shard_of(F.col(key), shards, seed).alias("shard"),
        spread.cast("int").alias("bucket"),
    )
    out = T.StructType([*placed.schema.fields, T.StructField("pos", T.LongType())])

    def permute(table: pa.Table) -> pa.Table:
        b = int(table["shard"][0].as_py()) * buckets + int(table["bucket"][0].as_py())
        table = table.combine_chunks()
        # rows arrive in any order; a fixed order first makes a repeated task write the same bucket
        names = pa.array(np.arange(len(table)))
        hashes = pa.array([hash_row(r) for r in _keys(table, key, text)])
        table = table.take(pa.compute.sort_indices(pa.table({"h": hashes, "n": names}), sort_keys=[("h", "ascending"), ("n", "ascending")]))
        order = fisher_yates(len(table), seed * 1_000_003 + b)
        return table.take(pa.array(order)).append_column("pos", pa.array(np.arange(len(table)), pa.int64()))

    shuffled = placed.groupBy("shard", "bucket").applyInArrow(permute, out)
    path = path or fresh_folder(spark, "shards")
    shuffled.write.partitionBy("shard", "bucket").option("compression", "zstd").parquet(path)
    written = spark.read.schema(out).parquet(path)
    counts = written.groupBy("shard", "bucket").agg(F.count("*").alias("n_rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    manifest = counts.withColumn("first_slot", F.coalesce(F.sum("n_rows").over(before), F.lit(0)))
    return written, manifest


def hash_row(value: tuple) -> bytes:
    import hashlib

    return hashlib.blake2b(repr(value).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _keys(table: pa.Table, key: str, text: str):
    rows = table["row"].combine_chunks()
    if isinstance(rows, pa.ChunkedArray):
        rows = rows.chunk(0)
    keys, texts = rows.field(key), rows.field(text)
    for i in range(len(rows)):
        yield keys[i].as_py(), texts[i].as_py()
