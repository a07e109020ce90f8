"""Correlation, normalisation and clustering of arrays held as long tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlake.operators.graph import settle

def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation within a group; null with fewer than two rows or without variance."""
    xy, xx, yy = F.covar_pop(x, y), F.var_pop(x), F.var_pop(y)
    return F.try_divide(xy, F.nullif(F.sqrt(xx * yy), F.lit(0.0)))

def correlate_columns(a: DataFrame, b: DataFrame, collapse: bool = False, max_columns: int = 4096) -> DataFrame:
    """(c1, c2, r): Pearson correlation of the columns of two long arrays (row, col, value): all pairs, or equal columns.

    For all pairs each task adds up the products of its rows as matrices of columns by
    columns (at most ``max_columns`` each), whose entries are then summed; a row that
    lacks either column counts for no pair of it.
    """
    left = a.select("row", F.col("col").alias("c1"), F.col("value").cast("double").alias("x"))
    right = b.select("row", F.col("col").alias("c2"), F.col("value").cast("double").alias("y"))
    if collapse:
        both = left.join(right, (left["row"] == right["row"]) & (F.col("c1") == F.col("c2")))
        return both.groupBy("c1", "c2").agg(guarded_corr(F.col("x"), F.col("y")).alias("r"))
    names = []
    for df, c in ((left, "c1"), (right, "c2")):
        found = sorted(r[0] for r in df.select(c).distinct().limit(max_columns + 1).collect())
        if len(found) > max_columns:
            raise ValueError(f"more than {max_columns} columns")
        names.append(np.array(found))
    pack = lambda df, c, v: df.where(f"{v} is not null").groupBy("row").agg(F.collect_list(c).alias(c), F.collect_list(v).alias(v))
    rows = pack(left, "c1", "x").join(pack(right, "c2", "y"), "row").drop("row")
    shape = (len(names[0]), len(names[1]))

    def dense(cols, values, known):
        out = np.full((len(cols), len(known)), np.nan)
        for i, (c, v) in enumerate(zip(cols, values, strict=True)):
            out[i, np.searchsorted(known, c)] = v
        return out

    def sums(batches):
        total = np.zeros((6, *shape))
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.iloc[lo : lo + 1024]
                x, y = dense(part["c1"], part["x"], names[0]), dense(part["c2"], part["y"], names[1])
                here, there = (~np.isnan(m) * 1.0 for m in (x, y))
                x, y = np.nan_to_num(x), np.nan_to_num(y)
                total += [here.T @ there, x.T @ there, here.T @ y, (x * x).T @ there, here.T @ (y * y), x.T @ y]
        i, j = np.indices(shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), **{k: t.ravel() for k, t in zip(("n", "sx", "sy", "sxx", "syy", "sxy"), total, strict=True)}})

    parts = rows.mapInPandas(sums, "i long, j long, n double, sx double, sy double, sxx double, syy double, sxy double")
    t = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]).where("n > 0")
    spread = lambda s, ss: F.greatest(F.lit(0.0), F.col("n") * F.col(ss) - F.col(s) * F.col(s))
    r = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.nullif(F.sqrt(spread("sx", "sxx") * spread("sy", "syy")), F.lit(0.0)))
    spark = a.sparkSession
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((left, "c1"), (right, "c2"))]
    c1, c2 = (spark.createDataFrame([(k, v.item()) for k, v in enumerate(names[n])], f"{k} long, c{n + 1} {kinds[n]}") for n, k in enumerate("ij"))
    # at most max_columns rows each
    return t.select("i", "j", r.alias("r")).join(F.broadcast(c1), "i").join(F.broadcast(c2), "j").select("c1", "c2", "r")

class VirtualConnectome:
    """The correlations of all columns of a long array (row, col, value), computed for the slice that is asked for."""

    def __init__(self, series: DataFrame):
        self.series = series

    def columns(self, which) -> DataFrame:
        """The series of some columns: a slice, or a list of numbers."""
        if isinstance(which, slice):
            keep = F.lit(True)
            if which.start is not None:
                keep &= F.col("col") >= which.start
            if which.stop is not None:
                keep &= F.col("col") < which.stop
            if which.step not in (None, 1):
                keep &= F.pmod(F.col("col") - (which.start or 0), F.lit(which.step)) == 0
            return self.series.where(keep)
        return self.series.where(F.col("col").isin(list(which)))

    def __getitem__(self, item) -> DataFrame:
        first, second = item
        return correlate_columns(self.columns(first), self.columns(second))

def average_ranks(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Ranks within groups; ties share their mean rank.

    Distinct values are counted and summed by ranges, so that no task sorts a group.
    """
    from meshlake.operators.binning import running

    counts = df.groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    placed = running(counts, order=(*by, "v"))
    start = placed.groupBy(*by).agg(F.min("before").alias("start"))
    ranks = placed.join(start, by).select(*by, "v", (F.col("before") - F.col("start") + (F.col("n") + 1) / 2).alias(name))
    return df.withColumn("v", F.col(value).cast("double")).join(ranks, [*by, "v"]).drop("v")

def spearman(a: DataFrame, b: DataFrame, by: list[str], feature: str = "feature", select: DataFrame | None = None) -> DataFrame:
    """Rank correlation over features of two long arrays (…by, feature, value) for each group; over the features of ``select`` if given."""
    both = a.select(*by, feature, F.col("value").alias("x")).join(b.select(*by, feature, F.col("value").alias("y")), [*by, feature])
    if select is not None:
        both = both.join(select.select(feature).distinct(), feature, "left_semi")
    return rank_correlation(both, by)

def rank_correlation(both: DataFrame, by: list[str]) -> DataFrame:
    """(…by, rho) of pairs of values (…by, x, y)."""
    ranked = average_ranks(average_ranks(both, "x", by, "rx"), "y", by, "ry")
    return ranked.groupBy(*by).agg(guarded_corr(F.col("rx"), F.col("ry")).alias("rho"))

def grouped_spearman(a: DataFrame, b: DataFrame, by: list[str], structures: DataFrame, feature: str = "feature") -> DataFrame:
    """(…by, group, rho): rank correlations over all features and over those of each structure group (feature, structure).

    Values are paired before they are repeated for the groups they count in.
    """
    groups = structure_groups(structures.select(feature, "structure")).select(feature, "group")
    both = a.select(*by, feature, F.col("value").alias("x")).join(b.select(*by, feature, F.col("value").alias("y")), [*by, feature])
    both = settle(both.join(groups, feature).select(*by, "group", "x", "y"))
    return rank_correlation(both, [*by, "group"])

def structure_groups(df: DataFrame, structure: str = "structure") -> DataFrame:
    """Rows repeated for each group they count in: full, their own cortical structure, cortex, sub_cortical, left, right."""
    s = F.upper(structure)
    cortex = s.contains("CORTEX")
    tags = F.array_compact(F.array(F.lit("full"), F.when(cortex, F.col(structure)), F.when(cortex, F.lit("cortex")).otherwise(F.lit("sub_cortical")), F.when(s.endswith("LEFT"), F.lit("left")), F.when(s.endswith("RIGHT"), F.lit("right"))))
    return df.withColumn("group", F.explode(tags))

def normalise(df: DataFrame, rank_threshold: float = 2.3, demean: bool = True, max_columns: int = 4096) -> DataFrame:
    """(element, time, value) over the standard deviation of what strong components leave unexplained.

    Elements are demeaned; spatial maps of the thin SVD are set to zero below
    ``rank_threshold`` standard deviations; the residual's deviation scales all values.
    Times are the short side (at most ``max_columns``): the driver gets their Gram matrix.
    """
    rows = df.groupBy("element").agg(F.sort_array(F.collect_list(F.struct("time", "value"))).alias("s"))
    rows = settle(rows.select("element", F.transform("s", lambda p: p["time"]).alias("times"), F.transform("s", lambda p: p["value"].cast("double")).alias("values")))
    n = rows.agg(F.max(F.size("times"))).first()[0] or 0
    if n == 0:
        return df.select("element", "time", "value")
    if n > max_columns:
        raise ValueError(f"{n} times; at most {max_columns}")

    def centred(pdf):
        x = np.vstack(pdf["values"].to_numpy())
        return x - x.mean(1, keepdims=True) if demean else x

    def gram(batches):
        total = np.zeros((n, n))
        for b in batches:
            if len(b):
                x = centred(b)
                total += x.T @ x
        yield pd.DataFrame({"g": [total.tobytes()]})

    # partial sums meet in a few tasks before the driver sees them
    def add(batches):
        yield pd.DataFrame({"g": [sum((np.frombuffer(g, float) for b in batches for g in b["g"]), np.zeros(n * n)).tobytes()]})

    parts = rows.mapInPandas(gram, "g binary").repartition(4).mapInPandas(add, "g binary").collect()
    values, v = np.linalg.eigh(sum(np.frombuffer(p[0], float) for p in parts).reshape(n, n))
    keep = values > max(values.max(), 0) * 1e-12
    s, v = np.sqrt(values[keep]), v[:, keep]

    def moments(batches):
        count, one, two = 0, np.zeros(len(s)), np.zeros(len(s))
        for b in batches:
            if len(b):
                u = centred(b) @ v / s
                count, one, two = count + len(u), one + u.sum(0), two + (u * u).sum(0)
        yield pd.DataFrame({"n": [count], "one": [one.tolist()], "two": [two.tolist()]})

    got = rows.mapInPandas(moments, "n long, one array<double>, two array<double>").collect()
    m, one, two = (sum(np.array(r[k]) for r in got) for k in range(3))
    bound = rank_threshold * np.sqrt(np.maximum(two / m - (one / m) ** 2, 0))

    def residual(b):
        x = centred(b)
        u = x @ v / s
        return x, x - np.where(np.abs(u) < bound, 0, u) * s @ v.T

    def spread(batches):
        count, one, two = 0, 0.0, 0.0
        for b in batches:
            if len(b):
                r = residual(b)[1]
                count, one, two = count + r.size, one + r.sum(), two + (r * r).sum()
        yield pd.DataFrame({"n": [count], "one": [one], "two": [two]})

    c, o, t = (float(x) for x in rows.mapInPandas(spread, "n long, one double, two double").agg(F.sum("n"), F.sum("one"), F.sum("two")).first())
    std = max((t / c - (o / c) ** 2) ** 0.5, 1e-300)

    def scaled(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"element": b["element"], "times": b["times"], "values": list(centred(b) / std)})

    kind = df.schema["element"].dataType.simpleString()
    time = df.schema["time"].dataType.simpleString()
    out = rows.mapInPandas(scaled, f"element {kind}, times array<{time}>, values array<double>")
    return out.select("element", F.explode(F.arrays_zip("times", "values")).alias("z")).select("element", F.col("z.times").alias("time"), F.col("z.values").alias("value"))

def close_pairs(features: DataFrame, max_rows: int = 20_000, block: int = 256) -> DataFrame:
    """(src, dst, d): Euclidean distances of all pairs of ``features`` (vertex, features), for operators that take a full matrix.

    The checked number of rows goes to every task, which takes its own rows against
    them in blocks; more than ``max_rows`` are refused.
    """
    n = features.count()
    if n > max_rows:
        raise ValueError(f"{n} rows; a full matrix takes {max_rows} at most")
    every = features.orderBy("vertex").toPandas()
    ids, x = every["vertex"].to_numpy(), np.array(every["features"].tolist(), float).reshape(n, -1)
    shared = features.sparkSession.sparkContext.broadcast((ids, x))

    def run(batches):
        ids, x = shared.value
        for b in batches:
            for lo in range(0, len(b), block):
                part = b.iloc[lo : lo + block]
                y = np.array(part["features"].tolist(), float)
                d = np.sqrt(np.maximum(((y[:, None, :] - x[None]) ** 2).sum(2), 0)) if len(y) * x.size < 4e7 else np.sqrt(np.maximum((y * y).sum(1)[:, None] + (x * x).sum(1) - 2 * y @ x.T, 0))
                yield pd.DataFrame({"src": np.repeat(part["vertex"].to_numpy(), len(ids)), "dst": np.tile(ids, len(part)), "d": d.ravel()})

    return features.select("vertex", "features").mapInPandas(run, "src long, dst long, d double")

def dbscan(near: DataFrame, vertices: DataFrame, min_samples: int = 5) -> DataFrame:
    """(vertex, cluster) of a table (src, dst) of pairs within eps, both ways, each with itself; -1 is noise.

    Core points have ``min_samples`` neighbours; clusters are components of core
    points, named by their least; a border point joins its neighbours' least cluster.
    """
    from meshlake.operators.graph import components

    core = settle(near.groupBy(F.col("src").alias("vertex")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_samples).select("vertex"))
    label = components(vertices, near.where("src <> dst"), core)
    border = near.join(label.withColumnRenamed("vertex", "dst"), "dst").groupBy(F.col("src").alias("vertex")).agg(F.min("component").alias("near"))
    out = vertices.select("vertex").join(label, "vertex", "left").join(border, "vertex", "left")
    return out.select("vertex", F.coalesce("component", "near", F.lit(-1)).alias("cluster"))

def spectral(similarity: DataFrame, k: int, max_iter: int = 20) -> DataFrame:
    """(vertex, cluster) by power iteration on a similarity table (src, dst, weight)."""
    from pyspark.ml.clustering import PowerIterationClustering

    pic = PowerIterationClustering(k=k, maxIter=max_iter, initMode="degree", srcCol="src", dstCol="dst", weightCol="weight")
    return pic.assignClusters(similarity.where("src < dst").select("src", "dst", "weight")).select(F.col("id").alias("vertex"), "cluster")

def affinity(similarity: np.ndarray, damping: float = 0.5, rounds: int = 200) -> np.ndarray:
    """Exemplar of each row of a similarity matrix by message passing (the diagonal holds preferences)."""
    s = similarity.astype(float)
    n = len(s)
    r, a = np.zeros((n, n)), np.zeros((n, n))
    here = np.arange(n)
    for _ in range(rounds):
        both = a + s
        best = both.argmax(1)
        first = both[here, best]
        both[here, best] = -np.inf
        new = s - first[:, None]
        new[here, best] = s[here, best] - both.max(1)
        r = damping * r + (1 - damping) * new
        p = np.maximum(r, 0)
        p[here, here] = r[here, here]
        new = p.sum(0)[None] - p
        own = new[here, here].copy()
        new = np.minimum(new, 0)
        new[here, here] = own
        a = damping * a + (1 - damping) * new
    centres = np.flatnonzero((a + r)[here, here] > 0)
    if not len(centres):
        return np.full(n, -1)
    out = centres[s[:, centres].argmax(1)]
    out[centres] = centres
    return out

def affinity_groups(similarity: DataFrame, max_rows: int = 2000) -> DataFrame:
    """(group, vertex, exemplar) for a table (group, src, dst, weight) of small groups, one task each."""
    largest = similarity.groupBy("group").agg(F.count_distinct("src").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > max_rows:
        raise ValueError(f"a group has {largest} rows; message passing takes {max_rows} at most")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([pdf["src"], pdf["dst"]]))
        s = np.full((len(ids), len(ids)), pdf["weight"].min())
        s[np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"])] = pdf["weight"]
        s[np.arange(len(ids)), np.arange(len(ids))] = np.median(pdf["weight"])
        got = affinity(s)
        return pd.DataFrame({"group": pdf["group"].iloc[0], "vertex": ids, "exemplar": [ids[g] if g >= 0 else -1 for g in got]})

    return similarity.select("group", "src", "dst", "weight").groupBy("group").applyInPandas(run, "group long, vertex long, exemplar long")

#: Bytes of matrices that message passing holds in memory; larger ones lie in unnamed temporary files of the task.
HELD = 200_000_000

def _square(n: int) -> np.ndarray:
    import tempfile

    return np.zeros((n, n)) if 3 * n * n * 8 <= HELD else np.memmap(tempfile.TemporaryFile(), float, "w+", shape=(n, n))

def _middle(s: np.ndarray, step: int) -> float:
    """The median of a matrix without positive entries, by digits of its sizes, a few rows at a time."""
    if not isinstance(s, np.memmap):
        return float(np.median(s))

    def at(rank: int) -> float:
        prefix = 0
        for shift in (48, 32, 16, 0):
            counts = np.zeros(1 << 16, np.int64)
            for lo in range(0, len(s), step):
                bits = np.abs(s[lo : lo + step]).view(np.uint64).ravel()
                if shift < 48:
                    bits = bits[(bits >> np.uint64(shift + 16)) == np.uint64(prefix)]
                counts += np.bincount(((bits >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
            upto = np.cumsum(counts)
            digit = int(np.searchsorted(upto, rank, "right"))
            rank -= int(upto[digit - 1]) if digit else 0
            prefix = prefix << 16 | digit
        return -float(np.array([prefix], np.uint64).view(float)[0])

    return (at((s.size - 1) // 2) + at(s.size // 2)) / 2

def affinity_of_rows(x: np.ndarray, damping: float = 0.5, rounds: int = 200) -> np.ndarray:
    """``affinity`` of the negative distances of rows, their median as preference, a few rows of the matrices at a time.

    A round updates availabilities of the round before and responsibilities in one pass.
    It ends early once a round changes no bit, as all further ones would not.
    """
    n = len(x)
    s, r, a = (_square(n) for _ in range(3))
    fill = max(1, 4_000_000 // max(x.size, 1))
    for lo in range(0, n, fill):
        s[lo : lo + fill] = -np.sqrt(((x[lo : lo + fill, None, :] - x[None]) ** 2).sum(2))
    step = max(1, 1_000_000 // n)
    s[np.arange(n), np.arange(n)] = _middle(s, step)
    total = own = None
    for turn in range(rounds + 1):
        sums, diagonal, same = np.zeros(n), np.zeros(n), True
        for lo in range(0, n, step):
            at = slice(lo, min(lo + step, n))
            here, mine = np.arange(at.stop - lo), np.arange(lo, at.stop)
            rb, ab, sb = r[at], a[at], s[at]
            if turn:
                p = np.maximum(rb, 0)
                p[here, mine] = own[mine]
                new = total[None] - p
                keep = new[here, mine].copy()
                new = np.minimum(new, 0)
                new[here, mine] = keep
                new = damping * ab + (1 - damping) * new
                same = same and np.array_equal(new, ab)
                a[at] = ab = new
            if turn == rounds:
                continue
            both = ab + sb
            best = both.argmax(1)
            first = both[here, best]
            both[here, best] = -np.inf
            new = sb - first[:, None]
            new[here, best] = sb[here, best] - both.max(1)
            new = damping * rb + (1 - damping) * new
            same = same and np.array_equal(new, rb)
            r[at] = new
            p = np.maximum(new, 0)
            diagonal[mine] = p[here, mine] = new[here, mine]
            sums += p.sum(0)
        if turn == rounds or turn and same:
            break
        total, own = sums, diagonal
    here = np.arange(n)
    centres = np.flatnonzero((a[here, here] + r[here, here]) > 0)
    if not len(centres):
        return np.full(n, -1)
    out = np.concatenate([centres[s[lo : lo + step][:, centres].argmax(1)] for lo in range(0, n, step)])
    out[centres] = centres
    return out

def affinity_features(features: DataFrame) -> DataFrame:
    """(group, vertex, exemplar) of ``features`` (group, vertex, features) by message passing within groups, one task each.

    As ``affinity_groups`` of all pairs within groups, which are never a table. Time
    grows with the square of a group, memory does not: three matrices of a large one lie on disk.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vertex")
        ids = pdf["vertex"].to_numpy()
        got = affinity_of_rows(np.array(pdf["features"].tolist(), float)) if len(ids) > 1 else np.array([-1])
        return pd.DataFrame({"group": pdf["group"], "vertex": ids, "exemplar": np.where(got >= 0, ids[got], -1)})

    # a group a task: small tables would else be put together
    dealt = features.select("group", "vertex", "features").repartitionByRange(max(1, features.select("group").distinct().count()), "group")
    return dealt.groupBy("group").applyInPandas(run, "group long, vertex long, exemplar long")

def fit_sigmoid(points: DataFrame, rounds: int = 60, rate: float = 0.5) -> tuple[float, float]:
    """(d0, sigma) of the least-squares sigmoid of ``points`` (dist, value): sums in Spark, steps on the driver."""
    d0, log_sigma = points.agg(F.avg("dist"), F.log(F.greatest(F.stddev_pop("dist"), F.lit(1e-6)))).first()
    for _ in range(rounds):
        z = (F.col("dist") - d0) / float(np.exp(log_sigma))
        y = 1 / (1 + F.exp(-z))
        e, slope = y - F.col("value"), y * (1 - y)
        # Gauss-Newton normal equations for (d0, log sigma)
        j0, j1 = -slope / float(np.exp(log_sigma)), -slope * z
        s = points.agg(*[F.sum(t) for t in (j0 * j0, j0 * j1, j1 * j1, j0 * e, j1 * e)]).first()
        a = np.array([[s[0], s[1]], [s[1], s[2]]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(a, [s[3], s[4]])
        d0, log_sigma = d0 - rate * step[0], log_sigma - rate * float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-9:
            break
    return float(d0), float(np.exp(log_sigma))

def radial_transition(points: DataFrame, edges: DataFrame, min_dist: float = -2.0, smooth_weight: float = 0.7, rounds: int = 40, damping: float = 0.7) -> DataFrame:
    """(vertex, offset, log_width, width) of the sigmoid in distance that the radial index follows around each vertex.

    ``points`` (vertex, dist, radial_index) are voxels with their nearest vertex and
    signed distance; those at ``min_dist`` or below, at distance 0 or with an index of 0, NaN or
    null take no part. A round takes a damped Gauss-Newton step for every vertex, in
    which offset and log width are held to the mean of the neighbours' values of the round before
    by ``smooth_weight``. Vertices without voxels follow their neighbours.
    """
    r = F.abs("radial_index")
    use = points.where((F.col("dist") > min_dist) & (F.col("dist") != 0) & (r > 0) & ~F.isnan("radial_index")).select("vertex", "dist", r.alias("r"))
    use, near = settle(use), settle(edges.select("src", "dst").distinct())
    nodes = near.select(F.col("src").alias("vertex")).union(use.select("vertex")).distinct()
    now = settle(nodes.select("vertex", F.lit(0.5).alias("d"), F.lit(-0.5).alias("s")))
    for _ in range(rounds):
        z = (F.col("dist") - F.col("d")) / F.exp("s")
        y = 1 / (1 + F.exp(-z))
        e, slope = y - F.col("r"), y * (1 - y)
        jd, js = -slope / F.exp("s"), -slope * z
        sums = use.join(now, "vertex").groupBy("vertex").agg(*[F.sum(t).alias(n) for n, t in (("dd", jd * jd), ("ds", jd * js), ("ss", js * js), ("de", jd * e), ("se", js * e))])
        mean = near.join(now.select(F.col("vertex").alias("dst"), "d", "s"), "dst").groupBy(F.col("src").alias("vertex")).agg(F.avg("d").alias("md"), F.avg("s").alias("ms"))
        both = now.join(sums, "vertex", "left").join(mean, "vertex", "left")
        c = lambda k: F.coalesce(F.col(k), F.lit(0.0))
        w = F.when(F.col("md").isNotNull(), float(smooth_weight)).otherwise(0.0) + 1e-9
        gd, gs = c("de") + w * (F.col("d") - F.coalesce("md", "d")), c("se") + w * (F.col("s") - F.coalesce("ms", "s"))
        a, b, k = c("dd") + w, c("ds"), c("ss") + w
        det = a * k - b * b
        bounded = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
        step_d, step_s = bounded((k * gd - b * gs) / det), bounded((a * gs - b * gd) / det)
        new = settle(both.select("vertex", (F.col("d") - damping * step_d).alias("d"), (F.col("s") - damping * step_s).alias("s"), F.greatest(F.abs(step_d), F.abs(step_s)).alias("moved")))
        largest = new.agg(F.max("moved")).first()[0]
        now = new.drop("moved")
        if largest is None or largest < 1e-7:
            break
    return now.select("vertex", F.col("d").alias("offset"), F.col("s").alias("log_width"), F.exp("s").alias("width"))

def two_parts(weight: np.ndarray) -> np.ndarray:
    """0 or 1 for each row of a symmetric matrix of similarities: the sign of the second vector of its normalised Laplacian."""
    degree = weight.sum(1)
    if len(weight) < 2 or not (degree > 0).all():
        return np.zeros(len(weight), int)
    root = 1 / np.sqrt(degree)
    _, vectors = np.linalg.eigh(np.eye(len(weight)) - weight * root[:, None] * root)
    second = vectors[:, 1] * root
    return (second > 0).astype(int) if second[0] <= 0 else (second <= 0).astype(int)

def searchlight(edges: DataFrame, features: DataFrame, parcels: DataFrame, max_rows: int = 5000) -> DataFrame:
    """(vertex, border): the share of parcellations (vertex, run, parcel) in which a vertex is on the border of its parcel's two clusters.

    In each parcel, neighbours' similarity exp(-distance) splits it in two; a vertex is
    on the border where a neighbour in the parcel is in the other part. A parcel is one
    task; one of more than ``max_rows`` vertices is refused.
    """
    from meshlake.operators.graph import edge_dissimilarity

    largest = parcels.groupBy("run", "parcel").count().agg(F.max("count")).first()[0] or 0
    if largest > max_rows:
        raise ValueError(f"a parcel has {largest} vertices; at most {max_rows} can be split")
    near = settle(edge_dissimilarity(edges, features).select("src", "dst", F.exp(-F.col("value")).alias("w")))
    a, b = (parcels.select(F.col("vertex").alias(k), "run", "parcel") for k in ("src", "dst"))
    inner = near.join(a, "src").join(b, ["dst", "run", "parcel"]).select("run", "parcel", "src", "dst", "w")
    alone = parcels.select("run", "parcel", F.col("vertex").alias("src"), F.col("vertex").alias("dst"), F.lit(1e-9).alias("w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf["src"])
        at, to = np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"])
        w = np.zeros((len(ids), len(ids)))
        w[at, to] = pdf["w"]
        part = two_parts((w + w.T) / 2)
        out = np.zeros(len(ids))
        np.maximum.at(out, at, (part[at] != part[to]) * 1.0)
        return pd.DataFrame({"run": pdf["run"].iloc[0], "vertex": ids, "b": out})

    found = inner.unionByName(alone).groupBy("run", "parcel").applyInPandas(run, "run int, vertex long, b double")
    return found.groupBy("vertex").agg(F.avg("b").alias("border"))

def boundary_frequency(labelings: DataFrame, edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(vertex, border): the share of labelings (run, vertex, label) in which a neighbour has another label."""
    mine = edges.join(labelings.withColumnRenamed("vertex", "src"), "src").join(labelings.select(F.col("vertex").alias("dst"), F.col("label").alias("other"), "run"), ["dst", "run"])
    crossed = mine.groupBy("run", F.col("src").alias("vertex")).agg(F.max((F.col("label") != F.col("other")).cast("int")).alias("b"))
    return vertices.select("vertex").join(crossed.groupBy("vertex").agg(F.avg("b").alias("border")), "vertex", "left")

MOMENTS = [(i, j) for i in range(3) for j in range(i, 3)]

def principal_axis(df: DataFrame, by: list[str], vector: tuple[str, str, str], weight: str | None = None) -> DataFrame:
    """(…by, axis_x, axis_y, axis_z, value): the main axis of weighted directions in each group.

    Moments are summed in Spark; only six numbers a group reach the eigenvalue step.
    """
    w = F.col(weight) * F.col(weight) if weight else F.lit(1.0)
    return main_axis(df.select(*by, *[(w * F.col(vector[i]) * F.col(vector[j])).alias(f"m{i}{j}") for i, j in MOMENTS]), by)

def main_axis(moments: DataFrame, by: list[str], prefix: str = "m") -> DataFrame:
    """The main axis of each group of moments (…by, m00, m01, …), which are summed first."""
    m = moments.groupBy(*by).agg(*[F.sum(f"{prefix}{i}{j}").alias(f"m{i}{j}") for i, j in MOMENTS])
    schema = ", ".join([f"{c} {moments.schema[c].dataType.simpleString()}" for c in by] + ["axis_x double", "axis_y double", "axis_z double", "value double"])

    def run(batches):
        for b in batches:
            full = np.zeros((len(b), 3, 3))
            for i, j in MOMENTS:
                full[:, i, j] = full[:, j, i] = b[f"m{i}{j}"]
            values, vectors = np.linalg.eigh(full)
            axis = vectors[:, :, 2]
            sign = np.where(np.take_along_axis(axis, np.abs(axis).argmax(1)[:, None], 1) < 0, -1.0, 1.0)
            axis = axis * sign
            yield pd.DataFrame({**{c: b[c] for c in by}, "axis_x": axis[:, 0], "axis_y": axis[:, 1], "axis_z": axis[:, 2], "value": values[:, 2]})

    return m.mapInPandas(run, schema)
