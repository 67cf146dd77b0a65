"""Exact cosine near-duplicates by dual traversal of cover trees.

On unit vectors cosine >= c is Euclidean distance <= sqrt(2 - 2c).  Vectors of a label are dealt to
the nearest of a few pivots, in blocks of bounded size.  Every block gets a cover tree: nested
levels whose radii halve, each node with the exact largest distance to what it covers.  Pairs of
blocks, and inside them pairs of nodes, are pruned when the distance of their centres exceeds the
sum of their radii and the threshold distance; what is left at the leaves is compared exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, staged

THRESHOLD = 0.98
#: Distinct vectors in a block, on average: the memory of one task is two blocks.
BLOCK = 2048
#: Members under which a node is not divided further.
LEAF = 48
#: Slack on pruning bounds, far above rounding errors of unit vectors.
SLACK = 1e-7


class Tree:
    """A cover tree over the rows of ``x`` (unit vectors): ``root`` is a node
    ``(centre row, radius, rows, children)``; leaves have no children."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.leaf = x, leaf
        rows = np.arange(len(x))
        d = self._distances(0, rows)
        self.root = self._node(0, rows, d)

    def _distances(self, centre: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (self.x[rows] @ self.x[centre]), 0))

    def _node(self, centre: int, rows: np.ndarray, d: np.ndarray):
        stack_root = [centre, float(d.max()), rows, []]
        todo = [(stack_root, d)]
        while todo:
            node, d = todo.pop()
            centre, radius, rows, children = node
            if len(rows) <= self.leaf or radius <= SLACK:
                continue
            # centres of the next level: the node's own first, then the farthest row left, until
            # every row is within half the radius of a centre
            nearest, owner = d.copy(), np.zeros(len(rows), np.int64)
            centres = [centre]
            while nearest.max() > radius / 2:
                pick = int(nearest.argmax())
                new = self._distances(int(rows[pick]), rows)
                closer = new < nearest
                closer[pick] = True
                nearest[closer], owner[closer] = new[closer], len(centres)
                nearest[pick] = 0
                centres.append(int(rows[pick]))
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(len(centres) + 1))
            for k, c in enumerate(centres):
                own = order[cuts[k] : cuts[k + 1]]
                if len(own):
                    child = [c, float(nearest[own].max()), rows[own], []]
                    children.append(child)
                    todo.append((child, nearest[own]))
        return stack_root


def linked_pairs(a: Tree, b: Tree, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``i`` of ``a`` and ``j`` of ``b`` with cosine >= threshold (``i < j`` when ``a is b``)."""
    reach = math.sqrt(max(2 - 2 * threshold, 0)) + SLACK
    todo, found = [(a.root, b.root)], []
    while todo:
        m, n = todo.pop()
        if not m[3] and not n[3]:
            i, j = np.nonzero(a.x[m[2]] @ b.x[n[2]].T >= threshold)
            i, j = m[2][i], n[2][j]
            if a is b:
                keep = i < j if m is n else np.ones(len(i), bool)
                i, j = np.minimum(i, j)[keep], np.maximum(i, j)[keep]
            if len(i):
                found.append((i, j))
            continue
        ms, ns = m[3] or [m], n[3] or [n]
        cos = a.x[[q[0] for q in ms]] @ b.x[[q[0] for q in ns]].T
        gap = np.sqrt(np.maximum(2 - 2 * cos, 0))
        gap -= np.array([q[1] for q in ms])[:, None]
        gap -= np.array([q[1] for q in ns])[None, :]
        for p, q in zip(*np.nonzero(gap <= reach), strict=True):
            if a is b and m is n and p > q:
                continue  # the same pair of nodes from the other side
            todo.append((ms[p], ns[q]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def spanning_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The lowest row that each of n rows reaches by the links ``i, j``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of extreme components overflow or vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_duplicates(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    group: str = "label",
    threshold: float = THRESHOLD,
    block: int = BLOCK,
) -> DataFrame:
    """Links between vectors of one group with cosine >= ``threshold``, none missed, none more.

    Returns ``row`` (struct of all columns of the input row), ``n_links`` (other rows linked
    directly), ``component_id`` (smallest key reachable by links, its own included) and ``kept``
    (the row's key is the component's).

    A null group, or a vector that is null, empty, zero or holds a null or non-finite component,
    links with nothing; so do vectors of different lengths.  Equal vectors are compared once and
    counted as often as they occur, whatever share of the rows they are.  A null key never becomes
    a component id; a row without any key in reach gets null and is not kept.  An empty table gives
    an empty result; columns of any name travel in ``row``.
    """
    finite = ~F.exists("_v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = F.col("_g").isNotNull() & F.col("_v").isNotNull() & finite & F.exists("_v", lambda c: c != 0)
    rows = vectors.select(
        F.struct(*[vectors[c] for c in vectors.columns]).alias("row"),
        F.col(key).alias("_key"),
        F.col(group).alias("_g"),
        F.transform(F.col(vector), lambda c: c.cast("double") + F.lit(0.0)).alias("_v"),
    ).withColumn("_ok", F.coalesce(usable, F.lit(False)))
    classes = staged(
        rows.where("_ok")
        .groupBy("_g", "_v")
        .agg(F.count("*").alias("copies"), F.min("_key").alias("least"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "vector-classes",
    )
    placed = staged(_blocks(classes, block), "vector-blocks")
    links = staged(_links(placed, threshold), "vector-links")
    counts = links.where("root is null").groupBy("cid").agg(F.sum("n").alias("n"))
    reach = components(links.where("root is not null"), "cid", "root")
    known = (
        classes.join(counts, "cid", "left")
        .join(reach.withColumnRenamed("node", "cid"), "cid", "left")
        .withColumn("component", F.coalesce("component", "cid"))
    )
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "component").select(
        F.col("_g").alias("g"),
        F.col("_v").alias("v"),
        (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"),
        "component_id",
    )
    out = rows.join(known, F.col("_ok") & (F.col("_g") == F.col("g")) & (F.col("_v") == F.col("v")), "left")
    component = F.when(F.col("_ok"), F.col("component_id")).otherwise(F.col("_key"))
    return out.select(
        "row",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("_key") == component, F.lit(False)).alias("kept"),
    )


def _blocks(classes: DataFrame, block: int) -> DataFrame:
    """``cid, copies, g, v, cell, part``: the group's vectors at their nearest pivot, cells cut
    into parts of at most about ``block`` vectors.

    Pivots are the ``ceil(n / block)`` vectors of lowest hash of each group; the list of pivots is
    one row for ``block`` vectors and is joined by group, in lists of at most 64."""
    sized = classes.groupBy("_g", F.size("_v").alias("dim")).agg(F.count("*").alias("n"))
    want = F.least(F.ceil(F.col("n") / block), F.lit(64))
    marked = classes.withColumn("dim", F.size("_v")).join(sized, ["_g", "dim"])
    # each row is a pivot with a chance of want / n: the expected number is the wanted one
    chance = F.pmod(F.xxhash64(F.lit("pivot"), "cid"), F.lit(1 << 40)) / float(1 << 40)

    def unit(v):
        largest = F.array_max(F.transform(v, F.abs))
        scaled = F.transform(v, lambda c: c / largest)
        norm = F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda s, c: s + c * c))
        return F.transform(scaled, lambda c: c / norm)

    def dot(u, v):
        return F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, c: s + c)

    # only the few pivots are normalised: the scores of a vector are compared among themselves
    pivots = (
        marked.where(chance < want / F.col("n"))
        .groupBy(F.col("_g").alias("pg"), F.col("dim").alias("pdim"))
        .agg(F.collect_list(unit(F.col("_v"))).alias("pivots"))
    )
    joined = marked.join(pivots, (F.col("_g") == F.col("pg")) & (F.col("dim") == F.col("pdim")), "left")
    scores = F.transform("pivots", lambda p: dot(p, F.col("_v")))
    cell = F.coalesce(F.array_position(scores, F.array_max(scores)), F.lit(0))
    celled = joined.select("cid", "copies", F.concat_ws("|", "_g", "dim").alias("g"), F.col("_v").alias("v"), cell.alias("cell"))
    celled = staged(celled, "vector-cells")
    counts = celled.groupBy("g", "cell").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / block)
    return celled.join(counts, ["g", "cell"]).select(
        "cid", "copies", "g", "v", "cell", F.pmod(F.xxhash64(F.lit("part"), "cid"), parts).alias("part")
    )


def _links(placed: DataFrame, threshold: float) -> DataFrame:
    """Rows ``cid, n`` (copies linked, from one pair of blocks) and rows ``cid, root`` (links that
    span what a pair of blocks connects)."""

    def centre(part: pd.DataFrame) -> pd.DataFrame:
        x = _unit(part["v"])
        mean = x.mean(axis=0)
        size = np.sqrt((mean * mean).sum())
        mean = mean / size if size > 0 else x[0]
        radius = float(np.sqrt(np.maximum(2 - 2 * (x @ mean), 0)).max())
        first = part.iloc[0]
        return pd.DataFrame({"g": [first["g"]], "cell": [first["cell"]], "part": [first["part"]], "centre": [mean], "radius": [radius]})

    blocks = staged(
        placed.groupBy("g", "cell", "part").applyInPandas(
            centre, "g string, cell long, part long, centre array<double>, radius double"
        ),
        "vector-centres",
    )
    one, two = blocks.select(*[F.col(c).alias(f"{c}1") for c in blocks.columns]), blocks.select(
        *[F.col(c).alias(f"{c}2") for c in blocks.columns]
    )
    dot = F.aggregate(F.zip_with("centre1", "centre2", lambda p, q: p * q), F.lit(0.0), lambda s, c: s + c)
    gap = F.sqrt(F.greatest(2 - 2 * dot, F.lit(0.0))) - F.col("radius1") - F.col("radius2")
    reach = math.sqrt(max(2 - 2 * threshold, 0)) + SLACK
    ordered = F.struct("cell1", "part1") <= F.struct("cell2", "part2")
    pairs = (
        one.join(two, F.col("g1") == F.col("g2"))
        .where(ordered & (gap <= reach))
        .select(F.col("g1").alias("g"), "cell1", "part1", "cell2", "part2")
    )
    pairs = staged(pairs, "vector-pairs")
    left = pairs.select("*", F.col("cell1").alias("cell"), F.col("part1").alias("part"), F.lit(0).alias("side"))
    right = pairs.where("cell1 <> cell2 or part1 <> part2").select(
        "*", F.col("cell2").alias("cell"), F.col("part2").alias("part"), F.lit(1).alias("side")
    )
    dealt = placed.join(left.union(right), ["g", "cell", "part"]).select(
        "g", "cell1", "part1", "cell2", "part2", "side", "cid", "copies", "v"
    )

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        a, b = part[part["side"] == 0], part[part["side"] == 1]
        ta = Tree(_unit(a["v"]))
        tb = Tree(_unit(b["v"])) if len(b) else ta
        i, j = linked_pairs(ta, tb, threshold)
        cid = np.concatenate([a["cid"].to_numpy(), b["cid"].to_numpy()])
        copies = np.concatenate([a["copies"].to_numpy(), b["copies"].to_numpy()])
        if len(b):
            j = j + len(a)
        n = np.zeros(len(cid), np.int64)
        np.add.at(n, i, copies[j])
        np.add.at(n, j, copies[i])
        root = spanning_roots(len(cid), i, j)
        counted, moved = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(cid)))
        return pd.DataFrame(
            {
                "cid": np.concatenate([cid[counted], cid[moved]]),
                "n": np.concatenate([n[counted], np.zeros(len(moved), np.int64)]),
                "root": pd.array([None] * len(counted) + cid[root[moved]].tolist(), dtype="Int64"),
            }
        )

    return dealt.groupBy("g", "cell1", "part1", "cell2", "part2").applyInPandas(compare, "cid long, n long, root long")
