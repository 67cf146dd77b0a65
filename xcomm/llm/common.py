"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from xcomm.session import shared_folder

#: Bytes of a row group: what a task holds of a table that it writes.
ROW_GROUP = 32 << 20

#: White space that separates words: space and \\x09 to \\x0D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; removed when the driver's Python ends."""
    path = f"{shared_folder(spark).rstrip('/')}/xcomm-llm/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    _MADE.append(path)
    return path


_MADE: list[str] = []


@contextmanager
def only_folder(spark: SparkSession, name: str):
    """Of the folders made inside, those whose names don't begin with ``name`` are removed at the end."""
    first = len(_MADE)
    yield
    for path in [p for p in _MADE[first:] if not p.rsplit("/", 1)[-1].startswith(name)]:
        _remove(spark, path)
        _MADE.remove(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session is already gone; the cluster cleans its folder
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, a lost executor
    costs a re-read of files, and later scans read only the columns they need."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Write ``df`` to the shared folder in buckets of ``key``, as many as there are shuffle partitions: a join
    on the key shuffles only the other side.  The table's name lives in the session's catalog."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"xcomm_{name}_{uuid.uuid4().hex}"
    out = df.repartition(n, key).write.option("path", fresh_folder(spark, name)).option("compression", "zstd")
    out.format("parquet").bucketBy(n, key).sortBy(key).saveAsTable(table)
    return spark.table(table)


def words(text: Column) -> Column:
    """Array of the words of a text (null: empty array)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words of a text as a long (null: 0)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of ``edges`` (columns ``a``, ``b`` of one type, no nulls) as
    ``node, component`` with the smallest node of each component.

    Rounds of contraction: every node moves to the neighbour (or itself) of lowest random
    priority, edges are renamed and emptied of loops.  A constant share of the nodes goes in each
    round whatever the shape (chain, star, clique), every step is a map-side combined grouping or
    an equi-join, and each round's small tables are written to the shared folder.
    """
    links = staged(
        edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "links"
    )
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    at = nodes.select("node", F.col("node").alias("now"))
    left, turn = links.count(), 0
    while left:
        priority = F.xxhash64(F.lit(turn), F.col("y"))
        both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a"))
        own = both.select("x", F.col("x").alias("y")).distinct()
        move = staged(
            both.union(own).groupBy("x").agg(F.min(F.struct(priority.alias("p"), "y"))["y"].alias("to")), "moves"
        )
        at = staged(
            at.join(move, at["now"] == move["x"], "left").select("node", F.coalesce("to", "now").alias("now")),
            "labels",
        )
        ends = move.select(F.col("x").alias("b"), F.col("to").alias("b2"))
        links = staged(
            links.join(move, links["a"] == move["x"])
            .select(F.col("to").alias("a2"), "b")
            .join(ends, "b")
            .where("a2 <> b2")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
            .distinct(),
            "links",
        )
        left, turn = links.count(), turn + 1
    least = at.groupBy("now").agg(F.min("node").alias("component"))
    return at.join(least, "now").select("node", "component")
