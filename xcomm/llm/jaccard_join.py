"""N-gram Jaccard join by vertical partitioning.

A document is the set of hashes of its word shingles.  The global order of shingles is the order of
their hashes, and fragments are ranges of that order, so every set is cut into the same segments.

Candidates: sets that differ in at most d shingles differ in at most d segments.  With more
segments than d, two similar sets agree in a whole segment, so only the hashes of segments are
shuffled (about one for every seven shingles), and shared passages or frequent shingles alone
make no candidates.  Where a lower similarity is asked for, the rarest first shingles are shuffled
instead, in an order from a sketch of all shingles' frequencies.

Verification: sets that meet in many segments are gathered in blocks of bounded size, and two
blocks are compared when a segment occurs in both.  In a task partial overlaps of all their pairs
are counted one fragment after the other, as matrix products, and summed per pair.  Only links
that span what a task connects leave it, so a group of thousands of similar texts never becomes
rows for all of its pairs.  Equal sets are one class from the start.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bitmaps import bit_map
from .common import components, staged
from .cover_tree import spanning_roots
from .textbytes import LOWER, mix, text_slices, word_hashes

WORDS = 3
PERCENT = 90
#: Sizes of a class of lengths grow by this factor.
GROWTH = 1.5
#: Shingles that a segment needs to make a candidate.
STRONG = 3
#: A set with few such segments also gives combinations of its first shingles: of so many shingles
#: each, where sets may differ in so many.
COMBINED = ((3, 8), (2, 30), (1, 1 << 40))
#: From this similarity on, whole segments are names; under it sets may differ in so many shingles
#: that segments get too small, and rare first shingles are.
SEGMENTS_FROM = 87
#: Then two similar sets share a name for every so many shingles of the smaller one.
COMMON = 20
#: Cells of the frequency sketch, as a power of two.
SKETCH_BITS = 23
#: Shingles that a block holds on average (a longer set is a block of its own).
BLOCK_SHINGLES = 300_000
#: Shingles that a set counts for at least: bounds the sets of a block, too.
LEAST_WEIGHT = 300
#: Bytes of a shingle's hash in the verification: two sets of n shingles miscount with a chance of
#: about n * n / 2**48.
WIDTH = 6
#: Shingles of one fragment of the verification: bounds its matrices.
FRAGMENT = 2048

def length_classes(limit: int) -> list[int]:
    """Lower edges of the classes of set sizes, up to beyond ``limit``."""
    edges = [1]
    while edges[-1] <= limit:
        edges.append(int(edges[-1] * GROWTH) + 1)
    return edges


_EDGES = np.array(length_classes(1 << 40))


def _class_shape(k: int, percent: int) -> tuple[int, int]:
    """Most differing shingles and number of fragments for pairs whose smaller set is of class k."""
    most = int(_EDGES[k + 1] - 1) * (100 - percent) // percent
    return most, int(1.4 * (most + 1)) + 2


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n_words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every document.  A document with fewer words than a
    shingle has one shingle, its whole sequence; one without words has none."""
    hashes, doc = word_hashes(LOWER[data], offsets)
    first = np.searchsorted(doc, np.arange(len(offsets)))
    turns = [np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0xD1342543DE82EF95 & (1 << 64) - 1) | np.uint64(1) for k in range(n_words)]

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        total = np.full(len(parts[0]), len(parts), np.uint64)
        for turn, part in zip(turns, parts, strict=False):
            total = mix(total + part * turn)
        return total

    full = len(hashes) - n_words + 1
    windows = joined([hashes[k : k + full] for k in range(n_words)]) if full > 0 else np.zeros(0, np.uint64)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= n_words:
            out.append(np.unique(windows[lo : hi - n_words + 1]))
        elif hi > lo:
            out.append(joined([hashes[k : k + 1] for k in range(lo, hi)]))
        else:
            out.append(hashes[:0])
    return out


def set_names(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set, as signed longs."""
    n = len(shingles)
    sums = [int(shingles.sum(dtype=np.uint64)) * 3 + n, int(mix(shingles + np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)) + n]
    one, two = mix(np.array([x & (1 << 64) - 1 for x in sums], np.uint64)).view(np.int64).tolist()
    return one, two


def segment_names(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Names under which a set meets every set that may be similar, as signed longs.

    The set takes part in the classes of all sizes that a smaller partner may have, its own
    included.  In a class with d differences at most, its segments of ``STRONG`` shingles or more
    are names.  If there are not more than d of these, the set also gives all combinations of c of
    its ``n - ceil(t n) + c`` first shingles, of which similar sets share one; c follows from the
    size of the smaller set, so a set gives those for all sizes that a partner may have.
    """
    n = len(shingles)
    least = -(-n * percent // 100)
    low, high = np.searchsorted(_EDGES, [least, n], "right") - 1
    names, weak = [], False
    for k in range(int(low), int(high) + 1):
        most, pieces = _class_shape(k, percent)
        if most == 0:
            continue  # in this class only equal sets are similar
        piece = ((shingles >> np.uint64(32)) * np.uint64(pieces)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
        counts = np.diff(np.append(starts, n))
        sums = np.add.reduceat(mix(shingles), starts)
        strong = counts >= STRONG
        mark = mix(piece[starts] + np.uint64((k + 1) << 40))
        names.append(mix(sums[strong] + mark[strong]))
        weak = weak or int(strong.sum()) <= most
    if weak:
        for c in {_combined(least, percent), _combined(n, percent)}:
            first = shingles[: n - least + c]
            for picked in [_choices(len(first), c)] if len(first) >= c else []:
                total = mix(first[picked]).sum(axis=1, dtype=np.uint64)
                names.append(mix(total ^ np.uint64(0x5DEECE66D1CEB00C + c)))
    return np.concatenate(names).view(np.int64) if names else np.zeros(0, np.int64)


def first_names(shingles: np.ndarray, percent: int, sketch: np.ndarray) -> np.ndarray:
    """Names by the prefix rule: of similar sets, the ``n - ceil(t n) + c`` first shingles share c, in
    any common order; c is a twentieth of the set (``common_names``), so a passage that two
    otherwise different documents share makes no candidates.  The order is by the cell of ``sketch`` that counts a shingle (rare ones
    first), then by hash, so passages that several documents share are rarely names."""
    n = len(shingles)
    count = n - -(-n * percent // 100) + -(-n // COMMON)
    order = (sketch[(shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(48)) | (shingles >> np.uint64(16))
    return mix(shingles[np.argsort(order, kind="stable")[:count]] ^ np.uint64(0x2545F4914F6CDD1D)).view(np.int64)


def with_common_names(met: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """``met`` (``segment, cid, least``) without the sets that have too few names in common with others:
    a partner of a set of n has ``ceil(t n)`` shingles at least, and shares a twentieth of that."""
    need = F.ceil(F.ceil(F.col("n") * percent / 100) / COMMON)
    enough = met.groupBy("cid").agg(F.count("*").alias("c")).join(sizes, "cid").where(F.col("c") >= need).select("cid")
    return shared_names(met.select("segment", "cid").join(enough, "cid", "left_semi"))


def shared_names(named: DataFrame) -> DataFrame:
    """``segment, cid, least`` of the names in ``named`` (``segment, cid``) that two sets or more have."""
    groups = Window.partitionBy("segment")
    found = named.withColumns({"least": F.min("cid").over(groups), "most": F.max("cid").over(groups)})
    return found.where("least < most").select("segment", "cid", "least")


def frequency_sketch(docs: DataFrame, text: str, n_words: int) -> np.ndarray:
    """Counts of shingles over all documents, in cells by their first ``SKETCH_BITS`` bits (capped at
    255): 8 MB, whatever the input.  Tasks count on their own, chunks of cells are summed."""
    cells, chunk = 1 << SKETCH_BITS, 1 << 11

    def count(batches):
        total = np.zeros(cells, np.uint32)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                sets = shingle_sets(data, offsets, n_words)
                if sets:
                    at, n = np.unique(np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS), return_counts=True)
                    total[at.astype(np.int64)] += n.astype(np.uint32)
        parts = np.minimum(total, 255).astype(np.uint8).reshape(-1, chunk)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([parts[k].tobytes() for k in used], pa.binary())], ["chunk", "counts"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.uint8) for x in part["counts"]], axis=0, dtype=np.int64)
        return pd.DataFrame({"chunk": part["chunk"].iloc[:1], "counts": [np.minimum(total, 255).astype(np.uint8).tobytes()]})

    schema = "chunk int, counts binary"
    found = docs.select(text).mapInArrow(count, schema).groupBy("chunk").applyInPandas(add, schema).toArrow()
    sketch = np.zeros((cells // chunk, chunk), np.uint8)
    for k, counts in zip(found["chunk"].to_pylist(), found["counts"].to_pylist(), strict=True):
        sketch[k] = np.frombuffer(counts, np.uint8)
    return sketch.ravel()


def _combined(n: int, percent: int) -> int:
    differ = n - -(-n * percent // 100)
    return next(c for c, most in COMBINED if differ <= most)


@lru_cache(maxsize=256)
def _choices(n: int, c: int) -> np.ndarray:
    return np.array(list(combinations(range(n), c)), np.int64).reshape(-1, c)


def describe(docs: DataFrame, text: str, keep: tuple[str, ...], n_words: int, percent: int) -> DataFrame:
    """``row`` (struct of ``keep``), ``n`` (set size), ``cid``, ``cid2`` (names of the set) and
    ``segments`` (names of candidates).  Of equal sets in one task only the first lists its segments."""
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), F.col(text).alias("text"))
    long = T.LongType()
    sketch = None if percent >= SEGMENTS_FROM else frequency_sketch(docs, text, n_words)
    nothing = np.zeros(0, np.int64)

    def names_of(shingles: np.ndarray) -> np.ndarray:
        return segment_names(shingles, percent) if sketch is None else first_names(shingles, percent, sketch)

    out = T.StructType(
        [rows.schema["row"], T.StructField("n", long), T.StructField("cid", long), T.StructField("cid2", long), T.StructField("segments", T.ArrayType(long))]
    )

    def work(batches):
        met = set()
        for batch in batches:
            n, one, two, segments = [], [], [], []
            for _, _, data, offsets in text_slices(batch.column("text")):
                for s in shingle_sets(data, offsets, n_words):
                    a, b = set_names(s)
                    new = len(s) > 0 and (a, b) not in met
                    met.add((a, b))
                    n.append(len(s))
                    one.append(a)
                    two.append(b)
                    segments.append(names_of(s) if new else nothing)
            ends = np.cumsum([0] + [len(s) for s in segments])
            flat = pa.array(np.concatenate(segments) if segments else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array(n, pa.int64()),
                    pa.array(one, pa.int64()),
                    pa.array(two, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat),
                ],
                ["row", "n", "cid", "cid2", "segments"],
            )

    return rows.mapInArrow(work, out)


def set_table(docs: DataFrame, ids: DataFrame, text: str, n_words: int) -> DataFrame:
    """``cid, n, shingles`` (packed, ``WIDTH`` bytes each) for the sets named in ``ids`` (column
    ``id``) and few others; a set comes once from each task that has it."""
    wanted = bit_map(ids)

    def work(batches):
        met = set()
        for batch in batches:
            cids, sizes, packed = [], [], []
            for _, _, data, offsets in text_slices(batch.column(0)):
                for s in shingle_sets(data, offsets, n_words):
                    if not len(s):
                        continue
                    name = set_names(s)
                    if name in met or not wanted.has(np.array([name[0]]).view(np.uint64))[0]:
                        continue
                    met.add(name)
                    cids.append(name[0])
                    sizes.append(len(s))
                    packed.append(np.ascontiguousarray(s.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["cid", "n", "shingles"]
            )

    return docs.select(text).mapInArrow(work, "cid long, n long, shingles binary")


def unpacked(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // WIDTH, 8), np.uint8)
    wide[:, 8 - WIDTH :] = np.frombuffer(packed, np.uint8).reshape(-1, WIDTH)
    return wide.view(">u8").ravel().astype(np.uint64)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Shared shingles of every set of ``a`` with every set of ``b``: the order of shingles is cut
    into fragments, each gives a matrix of partial overlaps, and these add up."""
    flat = [np.concatenate(x) for x in (a, b)]
    owner = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    place = [np.searchsorted(shared, f) for f in flat]
    known = [(p < len(shared)) & (shared[np.minimum(p, len(shared) - 1)] == f) if len(shared) else np.zeros(len(f), bool) for p, f in zip(place, flat, strict=True)]
    total = np.zeros((len(a), len(b)), np.float32)
    at = [p[k] for p, k in zip(place, known, strict=True)]
    own = [o[k] for o, k in zip(owner, known, strict=True)]
    order = [np.argsort(p, kind="stable") for p in at]
    at = [p[o] for p, o in zip(at, order, strict=True)]
    own = [w[o] for w, o in zip(own, order, strict=True)]
    for lo in range(0, len(shared), FRAGMENT):
        parts = []
        for p, w, n in zip(at, own, (len(a), len(b)), strict=True):
            first, last = np.searchsorted(p, [lo, lo + FRAGMENT])
            part = np.zeros((n, min(FRAGMENT, len(shared) - lo)), np.float32)
            part[w[first:last], p[first:last] - lo] = 1
            parts.append(part)
        total += parts[0] @ parts[1].T
    return total.astype(np.int64)


def _compare(percent: int):
    def compare(part: pd.DataFrame) -> pd.DataFrame:
        sides = [part[part["side"] == s].drop_duplicates("cid") for s in (0, 1)]
        if not len(sides[1]):
            sides[1] = sides[0]
        sets = [[unpacked(x) for x in side["shingles"]] for side in sides]
        na, nb = (side["n"].to_numpy() for side in sides)
        both = overlaps(*sets)
        similar = 100 * both >= percent * (na[:, None] + nb[None, :] - both)
        i, j = np.nonzero(similar)
        cid = np.concatenate([side["cid"].to_numpy() for side in sides])
        same = sides[0] is sides[1]
        root = spanning_roots(len(cid), i, j if same else j + len(na))
        moved = np.flatnonzero(root != np.arange(len(cid)))
        return pd.DataFrame({"a": cid[moved], "b": cid[root[moved]]})

    return compare


def dealt_blocks(met: DataFrame, sizes: DataFrame) -> DataFrame:
    """``block1, block2, side, cid``: the pairs of blocks to compare, with their sets, so that all sets
    that share a segment in ``met`` (``segment, cid, least``) meet.  ``sizes``: ``cid, n``.

    Sets that segments connect are cut into blocks of about ``BLOCK_SHINGLES`` shingles.  A set's
    home is the set that is least in most of its segments; sets of one home go to one block, unless
    they alone exceed it, so most links lie inside blocks."""
    share = met.groupBy("cid", "least").agg(F.count("*").alias("c"))
    home = share.groupBy("cid").agg(F.max(F.struct("c", "least"))["least"].alias("home"))
    near = components(share.where("cid <> least"), "cid", "least").withColumnRenamed("node", "cid")
    weight = F.greatest(F.col("n"), F.lit(LEAST_WEIGHT))
    sized = staged(sizes.select("cid", weight.alias("n")).join(home, "cid").join(near, "cid"), "jaccard-homes")
    parts = sized.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("parts"))
    large = sized.groupBy("home").agg((F.sum("n") > BLOCK_SHINGLES).alias("large"))
    spread = F.when(F.col("large"), F.xxhash64("cid")).otherwise(F.xxhash64("home"))
    block = F.xxhash64("component", F.pmod(spread, F.col("parts")))
    blocks = staged(sized.join(parts, "component").join(large, "home").select("cid", block.alias("block")), "jaccard-blocks")
    where = met.join(blocks, "cid").select("segment", "block").distinct()
    pairs = staged(
        where.select("segment", F.col("block").alias("block1"))
        .join(where.select("segment", F.col("block").alias("block2")), "segment")
        .where("block1 <= block2")
        .select("block1", "block2")
        .distinct(),
        "jaccard-pairs",
    )
    single = blocks.groupBy("block").agg(F.count("*").alias("n")).where("n = 1").select(F.col("block").alias("single"))
    pairs = pairs.join(single, (F.col("block1") == F.col("block2")) & (F.col("block1") == F.col("single")), "left_anti")
    left = pairs.select("*", F.col("block1").alias("block"), F.lit(0).alias("side"))
    right = pairs.where("block1 < block2").select("*", F.col("block2").alias("block"), F.lit(1).alias("side"))
    return staged(blocks.join(left.union(right), "block").select("block1", "block2", "side", "cid"), "jaccard-dealt")


def jaccard_components(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    keep: tuple[str, ...] | None = None,
    n_words: int = WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """Groups of documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Returns ``row`` (struct of ``keep``, by default the key), ``n_shingles``, ``class_id`` (names
    equal sets) and ``component_id``: the smallest key reachable by links, its own included.

    Null and empty texts, and texts of white space, have no shingles and link with nothing.  Equal
    rows and equal sets are one class.  A null key never is a component id; where no key is in
    reach it is null.  An empty table gives an empty result; columns of any name may be in
    ``keep``.  Shingles are compared by hashes, of 64 bits for candidates and 48 in the verification.
    """
    keep = keep or (key,)
    fields = tuple(dict.fromkeys([*keep, key]))
    rows = staged(describe(docs, text, fields, n_words, percent), "jaccard-rows")
    met = staged(shared_names(rows.select(F.explode("segments").alias("segment"), "cid")), "jaccard-met")
    sizes = rows.where("size(segments) > 0").groupBy("cid").agg(F.max("n").alias("n"))
    if percent < SEGMENTS_FROM:
        for _ in range(2):
            met = staged(with_common_names(met, sizes, percent), "jaccard-met")
    ids = staged(met.select(F.col("cid").alias("id")).distinct(), "jaccard-ids")
    dealt = dealt_blocks(met, sizes.join(ids, F.col("cid") == F.col("id"), "left_semi"))
    compared = dealt.join(set_table(docs, dealt.select(F.col("cid").alias("id")), text, n_words), "cid")
    links = compared.groupBy("block1", "block2").applyInPandas(_compare(percent), "a long, b long")
    reach = components(staged(links, "jaccard-links"), "a", "b")
    classes = (
        rows.where("n > 0")
        .groupBy("cid", "cid2")
        .agg(F.min(F.col("row")[key]).alias("least"))
        .join(reach.withColumnRenamed("node", "cid"), "cid", "left")
        .withColumn("component", F.coalesce("component", "cid"))
    )
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(smallest, "component").select(F.col("cid").alias("c1"), F.col("cid2").alias("c2"), "component_id")
    out = rows.select("row", "n", "cid", "cid2").join(
        named, (F.col("n") > 0) & (F.col("cid") == F.col("c1")) & (F.col("cid2") == F.col("c2")), "left"
    )
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("row")[key])
    return out.select(
        F.struct(*[F.col("row")[c].alias(c) for c in keep]).alias("row"),
        F.col("n").alias("n_shingles"),
        F.col("cid").alias("class_id"),
        own.alias("component_id"),
    )
