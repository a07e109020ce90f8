"""Clusterings that need the distances of all pairs of rows: pairs of blocks, one a task; distances are never written down.

Rows are packed into blocks of bounded size and each pair of blocks meets in a task,
which holds a few million distances at a time. Time grows with the square of the
rows, memory does not grow. Equal rows count as one with its number of copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlake.operators.graph import components, settle, unsettle

#: Rows of a block at most (nearly: rows are dealt by hash), and distances that a task holds at once.
BLOCK, TILE = 16_384, 2_000_000
#: Least number of blocks of a group, so that its pairs keep many tasks busy, as far as blocks have SMALL rows.
LEAST, SMALL = 12, 1024


def distinct_rows(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertex, rep): each row with the least vertex of equal ``features``; (vertex, n, features): those and their copies."""
    same = Window.partitionBy("features")
    rows = settle(features.select("vertex", "features", F.min("vertex").over(same).alias("rep"), F.count(F.lit(1)).over(same).alias("n")))
    return rows.select("vertex", "rep"), rows.where("vertex = rep").select("vertex", "n", "features")


def packed(rows: DataFrame, columns: list[str], least: int = LEAST) -> DataFrame:
    """(group, part, ids, x, …columns): ``rows`` (group, vertex, features, …) as blocks of binary arrays, ordered by vertex."""
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    parts = F.greatest(F.ceil(F.col("size") / BLOCK), F.least(F.lit(least), F.ceil(F.col("size") / SMALL))).cast("long")
    # one row for each group
    dealt = rows.join(F.broadcast(sizes), "group").withColumn("part", F.pmod(F.xxhash64("vertex"), parts))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vertex")
        x = np.array(pdf["features"].tolist(), np.float64)
        return pd.DataFrame({"group": pdf["group"].iloc[:1], "part": pdf["part"].iloc[:1], "ids": [pdf["vertex"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()], **{c: [pdf[c].to_numpy(np.float64).tobytes()] for c in columns}})

    schema = ", ".join(["group long, part long, ids binary, x binary", *[f"{c} binary" for c in columns]])
    return settle(dealt.select("group", "part", "vertex", "features", *columns).groupBy("group", "part").applyInPandas(pack, schema))


class Block:
    """A block's arrays: ids, x (rows by features) and the packed columns."""

    def __init__(self, row, side: str, columns: list[str]):
        self.key = row[f"group_{side}"], row[f"part_{side}"]
        self.ids = np.frombuffer(row[f"ids_{side}"], np.int64)
        self.x = np.frombuffer(row[f"x_{side}"]).reshape(len(self.ids), -1)
        for c in columns:
            setattr(self, c, np.frombuffer(row[f"{c}_{side}"]))


def meet(blocks: DataFrame, columns: list[str], work: Callable[[Block, Block], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What ``work`` gives for each pair of blocks of a group, each block with itself too."""
    n = blocks.count()
    dealt = blocks.repartitionByRange(max(n, 1), "group", "part")
    side = lambda s: dealt.select(*[F.col(c).alias(f"{c}_{s}") for c in dealt.columns])
    both = side("a").join(side("b").hint("shuffle_replicate_nl"), F.expr("group_a = group_b and part_a <= part_b"))

    def run(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                yield from work(Block(row, "a", columns), Block(row, "b", columns))

    return both.mapInPandas(run, schema)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ``a`` from the same rows of ``b``, by differences."""
    out = np.empty(len(a))
    for lo in range(0, len(a), 65_536):
        d = a[lo : lo + 65_536] - b[lo : lo + 65_536]
        out[lo : lo + 65_536] = (d * d).sum(1)
    return out


def distances(a: Block, b: Block, bound: float | None = None) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """(rows of a, rows of b, distances) in tiles. Of a block with itself each pair comes once, and its square tile is symmetric.

    Products of rows lose digits of small distances: those, or those close to ``bound``
    if given, are taken by differences.
    """
    same = a.key == b.key
    sa, sb = ((m.x * m.x).sum(1) for m in (a, b))
    left = np.hstack([-2 * a.x, np.ones((len(sa), 1)), sa[:, None]])
    right = np.ascontiguousarray(np.hstack([b.x, sb[:, None], np.ones((len(sb), 1))]).T)
    scale = float(sa.max(initial=0) + sb.max(initial=0))
    step = max(1, TILE // max(len(sb), 1))
    for lo in range(0, len(sa), step):
        hi, start = min(lo + step, len(sa)), lo if same else 0
        d2 = left[lo:hi] @ right[:, start:]
        i, j = np.nonzero(d2 < 1e-6 * scale) if bound is None else np.nonzero(np.abs(d2 - bound * bound) <= 1e-9 * max(scale, bound * bound))
        if len(i):
            d2[i, j] = exact(a.x[lo + i], b.x[start + j])
        if same:
            square = d2[:, : hi - lo]
            square[...] = np.triu(square, 1) + np.triu(square, 1).T
        np.maximum(d2, 0, out=d2)
        yield slice(lo, hi), slice(start, len(sb)), np.sqrt(d2, out=d2)


def _sides(a: Block, b: Block, start, mine, theirs) -> Iterator[pd.DataFrame]:
    """Rows (group, part, other, ids, value) of a pair's results; a block's ids come with the pair of it with itself."""
    same = a.key == b.key
    yield pd.DataFrame({"group": [a.key[0]], "part": [a.key[1]], "other": [b.key[1]], "ids": [a.ids.tobytes() if same else None], "value": [mine.tobytes()]})
    if not same:
        yield pd.DataFrame({"group": [b.key[0]], "part": [b.key[1]], "other": [a.key[1]], "ids": [None], "value": [theirs.tobytes()]})


def for_rows(blocks: DataFrame, columns: list[str], add: Callable, start: float = 0.0, fold=np.add, bound: float | None = None) -> DataFrame:
    """(group, vertex, value): for each row, over all rows of its group, what ``add`` makes of tiles of distances.

    ``add(d, one, other)`` gives a value for each row of a tile, ``one`` and ``other`` being
    the columns of its rows and of the rows across; ``fold`` puts values together.
    """

    def work(a: Block, b: Block):
        same = a.key == b.key
        mine, theirs = np.full(len(a.ids), start), np.full(len(b.ids), start)
        for ra, rb, d in distances(a, b, bound):
            one, other = ({c: getattr(m, c)[r] for c in columns} for m, r in ((a, ra), (b, rb)))
            mine[ra] = fold(mine[ra], add(d, one, other))
            # of a block with itself the square tile has both ways of its pairs already
            skip = ra.stop - ra.start if same else 0
            if skip < d.shape[1]:
                into, at = (mine if same else theirs), slice(rb.start + skip, rb.stop)
                into[at] = fold(into[at], add(d[:, skip:].T, {c: v[skip:] for c, v in other.items()}, one))
        yield from _sides(a, b, start, mine, theirs)

    got = meet(blocks, columns, work, "group long, part long, other long, ids binary, value binary")

    def put(pdf: pd.DataFrame) -> pd.DataFrame:
        total, ids = None, None
        for x, v in pdf.sort_values("other")[["ids", "value"]].itertuples(index=False):
            v = np.frombuffer(v)
            total, ids = v if total is None else fold(total, v), np.frombuffer(x, np.int64) if x is not None else ids
        return pd.DataFrame({"group": pdf["group"].iloc[0], "vertex": ids, "value": total})

    return settle(got.groupBy("group", "part").applyInPandas(put, "group long, vertex long, value double"))


def medoids(features: DataFrame, k: int, init: str | list[int] = "center", max_loops: int = 6, seed: int = 0) -> DataFrame:
    """(vertex, center): medoid clusters of ``features`` (vertex, features) by Euclidean distance, as ``graph.kmedoids`` has them of a full table.

    Two passes over all pairs find the most central vertices; a loop takes the pairs
    within clusters. The driver holds the k centres.
    """
    members, rows = distinct_rows(features)
    every = rows.withColumn("group", F.lit(0).cast("long"))
    if isinstance(init, list):
        centers = list(init)
    elif init == "random":
        centers = [r[0] for r in members.orderBy(F.xxhash64(F.lit(seed), "vertex"), "vertex").limit(k).select("vertex").collect()]
    else:
        weighed = lambda d, one, other: d @ other["w"]
        blocks = packed(every.withColumn("w", F.col("n").cast("double")), ["w"])
        total = for_rows(blocks, ["w"], weighed)
        unsettle(blocks)
        share = F.when(F.col("value") > 0, F.col("n") / F.when(F.col("value") > 0, F.col("value"))).otherwise(0.0)
        blocks = packed(every.join(total.select("vertex", "value").hint("merge"), "vertex").withColumn("w", share), ["w"])
        central = for_rows(blocks, ["w"], weighed)
        unsettle(blocks)
        ranked = members.join(central.select(F.col("vertex").alias("rep"), "value").hint("merge"), "rep")
        centers = [r[0] for r in ranked.orderBy("value", "vertex").limit(k).select("vertex").collect()]
    old = None
    for loop in range(max_loops):
        known = members.where(F.col("vertex").isin(centers)).join(rows.select(F.col("vertex").alias("rep"), "features").hint("merge"), "rep").select("vertex", "features").orderBy("vertex").collect()
        ids, at = np.array([r[0] for r in known]), np.array([r[1] for r in known], float)

        def nearest(batches, ids=ids, at=at):
            for b in batches:
                if len(b):
                    x = np.array(b["features"].tolist(), float)
                    best, which = np.full(len(x), np.inf), np.zeros(len(x), int)
                    for c in range(len(ids)):
                        d = np.sqrt(((x - at[c]) ** 2).sum(1))
                        which, best = np.where(d < best, c, which), np.minimum(d, best)
                    yield pd.DataFrame({"vertex": b["vertex"], "center": ids[which]})

        labels = settle(rows.select("vertex", "features").mapInPandas(nearest, "vertex long, center long"))
        if loop == max_loops - 1 or old is not None and labels.join(old.hint("merge"), ["vertex", "center"], "left_anti").isEmpty():
            break
        old = labels
        inner = rows.join(labels.hint("merge"), "vertex").select(F.col("center").alias("group"), "vertex", "features", F.col("n").cast("double").alias("w"))
        blocks = packed(inner, ["w"], 6)
        cost = for_rows(blocks, ["w"], lambda d, one, other: d @ other["w"])
        unsettle(blocks)
        centers = [r[0] for r in cost.groupBy("group").agg(F.min(F.struct("value", "vertex")).alias("m")).select("m.vertex").collect()]
        unsettle(cost)
    return members.join(labels.select(F.col("vertex").alias("rep"), "center").hint("merge"), "rep").select("vertex", "center")


def _joined(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The forest ``parent`` (each row's root) with the pairs u, v joined: the least row of each component."""
    while True:
        pu, pv = parent[u], parent[v]
        apart = pu != pv
        if not apart.any():
            return parent
        u, v, pu, pv = u[apart], v[apart], pu[apart], pv[apart]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def density_clusters(features: DataFrame, eps: float, min_samples: int = 5) -> DataFrame:
    """(vertex, cluster) of ``features`` (vertex, features), as ``stats.dbscan`` has them of the pairs within ``eps``; -1 is noise.

    One pass counts neighbours, one links core points, one finds the clusters of border
    points. Of its links a pair of blocks returns no more than hold its rows together.
    """
    members, rows = distinct_rows(features)
    every = rows.select(F.lit(0).cast("long").alias("group"), "vertex", "features", F.col("n").cast("double").alias("n"))
    blocks = packed(every, ["n"])
    near = lambda d: d <= eps
    counts = for_rows(blocks, ["n"], lambda d, one, other: near(d) @ other["n"], bound=eps)
    unsettle(blocks)
    cored = every.join(counts.where(F.col("value") >= min_samples).select("vertex", F.lit(1.0).alias("core")).hint("merge"), "vertex", "left").withColumn("core", F.coalesce("core", F.lit(0.0)))
    blocks = packed(cored.where("core = 1").select("group", "vertex", "features"), [])

    def links(a: Block, b: Block):
        same, n = a.key == b.key, len(a.ids)
        ids = a.ids if same else np.concatenate([a.ids, b.ids])
        parent = np.arange(len(ids))
        for ra, rb, d in distances(a, b, eps):
            u, v = np.nonzero(near(d))
            parent = _joined(parent, u + ra.start, v + rb.start + (0 if same else n))
        held = np.flatnonzero(parent != np.arange(len(ids)))
        yield pd.DataFrame({"src": ids[held], "dst": ids[parent[held]]})

    found = settle(meet(blocks, [], links, "src long, dst long"))
    unsettle(blocks)
    core = cored.where("core = 1").select("vertex")
    label = settle(components(core, found.union(found.select("dst", "src")).distinct()))
    unsettle(found)
    # numbers below 2^53 pass as they are
    blocks = packed(cored.join(label.withColumn("label", F.col("component").cast("double")).hint("merge"), "vertex", "left").withColumn("label", F.coalesce("label", F.lit(float("inf")))), ["label"])
    border = for_rows(blocks, ["label"], lambda d, one, other: np.where(near(d), other["label"], np.inf).min(1), start=np.inf, fold=np.minimum, bound=eps)
    unsettle(blocks)
    both = border.select(F.col("vertex").alias("rep"), "value").join(label.select(F.col("vertex").alias("rep"), "component").hint("merge"), "rep", "left")
    cluster = F.coalesce("component", F.when(F.col("value") < float("inf"), F.col("value").cast("long")), F.lit(-1).cast("long"))
    return members.join(both.select("rep", cluster.alias("cluster")).hint("merge"), "rep").select("vertex", "cluster")
