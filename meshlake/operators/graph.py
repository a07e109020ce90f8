"""Edge tables: neighbour dissimilarity, shortest paths, components, parcels, smoothing of values."""

from __future__ import annotations

import heapq
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlake.functions.metrics import dissimilarity

#: The largest group, in rows, that a sequential operator takes into one task.
LOCAL_ROWS = 2_000_000


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the folder of ``spark.checkpoint.dir`` and read it back, so that lineage ends there."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import atexit
        import shutil
        import tempfile

        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="meshlake-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", base)
    path, schema = f"{base.rstrip('/')}/settled-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.settled_at = path
    return out


def unsettle(df: DataFrame) -> None:
    """Delete what ``settle`` wrote down for a table that nothing reads any more."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.settled_at)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def edge_dissimilarity(edges: DataFrame, features: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(src, dst, value) for each edge: the metric of its ends' ``features`` (vertex, features)."""
    u = features.select(F.col("vertex").alias("src"), F.col("features").alias("u"))
    v = features.select(F.col("vertex").alias("dst"), F.col("features").alias("v"))
    return edges.join(u, "src").join(v, "dst").select("src", "dst", dissimilarity(metric, F.col("u"), F.col("v")).alias("value"))


REDUCTIONS = {"min": F.min, "max": F.max, "mean": F.avg, "median": F.median}


def reduce_edges(vertices: DataFrame, valued: DataFrame, method: str = "median") -> DataFrame:
    """(vertex, value): edge values reduced for each vertex, null for one without edges."""
    per = valued.groupBy(F.col("src").alias("vertex")).agg(REDUCTIONS[method]("value").alias("value"))
    return vertices.select("vertex").join(per, "vertex", "left")


def gradient(vertices: DataFrame, edges: DataFrame, features: DataFrame, metric: str = "euclidean", method: str = "median") -> DataFrame:
    """How much each vertex' features differ from its neighbours'."""
    return reduce_edges(vertices, edge_dissimilarity(edges, features, metric), method)


def partial_gradient(mesh, values: DataFrame, structure: str | None = None, exclude_same_region: bool = False, metric: str = "euclidean", method: str = "median") -> DataFrame:
    """(vertex, value) on the part of a mesh that has ``values`` (vertex, feature, value[, feature_structure]).

    Faces need all corners in that part. ``exclude_same_region`` leaves features of
    ``structure`` itself out, as in a connectome.
    """
    from meshlake.operators.mesh import Mesh, edges

    part = values.select("vertex").distinct()
    faces = mesh.faces
    for k in "abc":
        faces = faces.join(part.withColumnRenamed("vertex", k), k, "left_semi")
    kept = values.where(F.col("feature_structure") != structure) if exclude_same_region else values
    features = kept.groupBy("vertex").agg(F.sort_array(F.collect_list(F.struct("feature", F.col("value").cast("double").alias("value")))).alias("s"))
    features = features.select("vertex", F.transform("s", lambda x: x["value"]).alias("features"))
    return gradient(part, edges(Mesh(mesh.vertices, faces)), features, metric, method)


def transposed(entries: DataFrame) -> DataFrame:
    """(src, dst, value) of a connectome turned round."""
    return entries.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "value")


def sparse_min(entries: DataFrame, key: str | None = None) -> DataFrame:
    """Least stored entry of (row, col, value), with its place, over all or for each ``row`` or ``col``; ties take the first place."""
    best = F.min(F.struct("value", "row", "col")).alias("m")
    grouped = entries.groupBy(key).agg(best) if key else entries.agg(best)
    return grouped.select(*([key] if key else []), F.col("m.value").alias("value"), *([] if key == "row" else [F.col("m.row").alias("row")]), *([] if key == "col" else [F.col("m.col").alias("col")]))


#: Edges of a block of vertices, about, within which one task finds paths.
BLOCK_EDGES = 300_000


def _extend(edges: pd.DataFrame, known: pd.DataFrame, here: int, bounds: list[int]) -> pd.DataFrame:
    """Paths within a block: its vertices' paths (kind 0) once those of ``known`` (kind 1) have come in, and what leaves it (kind 1)."""
    none = float("-inf")
    edges = edges.sort_values("src", kind="stable")
    src, inside = edges["src"].to_numpy(), np.searchsorted(bounds, edges["dst"].to_numpy(), "right") == here
    ids, first = np.unique(src, return_index=True)
    spans = dict(zip(ids.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(src)], strict=True), strict=True))
    dst, w, inside = edges["dst"].tolist(), edges["w"].tolist(), inside.tolist()
    rows = list(zip(known["dist"].tolist(), known["root"].tolist(), [none if x is None or x != x else int(x) for x in known["pred"].tolist()], known["vertex"].tolist(), known["longer"].tolist(), known["kind"].tolist(), strict=True))
    label = {v: (d, r, p) for d, r, p, v, _, k in rows if k == 0}
    heap = [(d, r, p, v, longer) for d, r, p, v, longer, k in rows if k == 1]
    heapq.heapify(heap)
    out: dict = {}
    while heap:
        d, r, p, v, longer = heapq.heappop(heap)
        old = label.get(v)
        if old is not None and (d, r) >= old[:2]:
            # a lower predecessor on a way as short; over an edge of no length it could close a ring
            if (d, r) == old[:2] and longer and p < old[2]:
                label[v] = d, r, p
            continue
        label[v] = d, r, p
        for k in range(*spans.get(v, (0, 0))):
            step = (d + w[k], r, v, dst[k], w[k] > 0)
            if inside[k]:
                if dst[k] not in label or step[:2] <= label[dst[k]][:2]:
                    heapq.heappush(heap, step)
            elif dst[k] not in out or step < out[dst[k]]:
                out[dst[k]] = step
    found = [(v, d, r, p, True, 0) for v, (d, r, p) in label.items()] + [(v, d, r, p, longer, 1) for d, r, p, v, longer in out.values()]
    got = pd.DataFrame(found, columns=["vertex", "dist", "root", "pred", "longer", "kind"])
    return got.assign(pred=pd.array([None if x == none else int(x) for x in got["pred"]], dtype="Int64"))


def shortest_paths(edges: DataFrame, sources: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(vertex, dist, root, pred) from the nearest of ``sources`` (vertex) along ``edges`` (src, dst, w).

    Vertices are dealt by ranges of their numbers into blocks of about BLOCK_EDGES edges.
    A round finds all paths within the blocks that something came into, and sends on what
    leaves them, until nothing does; so rounds are as many as borders of blocks that a
    path crosses. Unreached vertices are not returned. Ties take the lower root, then the
    lower predecessor.
    """
    plain = settle(edges.select("src", "dst", F.col("w").cast("double").alias("w")))
    parts = -(-plain.count() // BLOCK_EDGES)
    bounds = sorted({int(x) for x in plain.approxQuantile("src", [k / parts for k in range(1, parts)], 0.1 / parts)}) if parts > 1 else []
    block = lambda c: F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x <= F.col(c))) if bounds else F.lit(0)
    near = settle(plain.withColumn("block", block("src")))
    unsettle(plain)
    start = sources.select("vertex", F.lit(0.0).alias("dist"), F.col("vertex").alias("root"), F.lit(None).cast("bigint").alias("pred"), F.lit(True).alias("longer"), F.lit(1).alias("kind")).distinct()
    now = settle(start.withColumn("block", block("vertex")))
    schema = "vertex long, dist double, root long, pred long, longer boolean, kind int"
    for _ in range(max_rounds):
        active = [r[0] for r in now.where("kind = 1").select("block").distinct().collect()]
        if not active:
            unsettle(near)
            return now.select("vertex", "dist", "root", "pred")
        here = F.col("block").isin(active)
        run = lambda key, e, k: _extend(e, k, int(key[0]), bounds)
        moved = near.where(here).groupBy("block").cogroup(now.where(here).groupBy("block")).applyInPandas(run, schema)
        merged = settle(moved.withColumn("block", block("vertex")).unionByName(now.where(~here)))
        unsettle(now)
        now = merged
    raise RuntimeError("paths did not settle")


def roi_distance(vertices: DataFrame, edges: DataFrame, roi: DataFrame) -> DataFrame:
    """Distance, nearest vertex and predecessor from a region, for every vertex (null where out of reach)."""
    return vertices.select("vertex").join(shortest_paths(edges, roi), "vertex", "left")


def project_nearest(distances: DataFrame, values: DataFrame) -> DataFrame:
    """(vertex, value): the value (vertex, value) of the region's nearest vertex."""
    return distances.join(values.select(F.col("vertex").alias("root"), "value"), "root", "left").select("vertex", "value")


def components(vertices: DataFrame, edges: DataFrame, mask: DataFrame | None = None, max_rounds: int = 1000) -> DataFrame:
    """(vertex, component): the least vertex that can be reached, within ``mask`` (vertex) if given."""
    nodes = vertices.select("vertex") if mask is None else mask.select("vertex").distinct()
    if mask is not None:
        edges = edges.join(nodes.withColumnRenamed("vertex", "src"), "src", "left_semi").join(nodes.withColumnRenamed("vertex", "dst"), "dst", "left_semi")
    edges = settle(edges.select("src", "dst"))
    label = whole = settle(nodes.select("vertex", F.col("vertex").alias("component")))
    for _ in range(max_rounds):
        near = edges.join(label.withColumnRenamed("vertex", "dst"), "dst").groupBy(F.col("src").alias("vertex")).agg(F.min("component").alias("n"))
        step = label.join(near, "vertex", "left").select("vertex", "component", F.least("component", F.coalesce("n", "component")).alias("n"))
        jump = label.select(F.col("vertex").alias("n"), F.col("component").alias("far"))
        now = settle(step.join(jump, "n").select("vertex", F.col("component").alias("old"), F.least("n", "far").alias("component")))
        unsettle(whole)
        label, whole = now.drop("old"), now
        if now.where("old <> component").isEmpty():
            unsettle(edges)
            return label
    raise RuntimeError("components did not settle")


def farthest_seeds(vertices: DataFrame, edges: DataFrame, n: int, first: int = 0) -> list[int]:
    """Seeds, each the farthest vertex from those before it (ties: the lowest)."""
    spark = vertices.sparkSession
    seeds, dist = [first], None
    while len(seeds) < n:
        new = shortest_paths(edges, spark.createDataFrame([(seeds[-1],)], "vertex bigint")).select("vertex", "dist")
        dist = settle(new if dist is None else dist.join(new.withColumnRenamed("dist", "d"), "vertex", "full").select("vertex", F.least("dist", "d").alias("dist")))
        far = dist.orderBy(F.desc("dist"), "vertex").first()
        if far is None or far["dist"] == 0:
            break
        seeds.append(far["vertex"])
    return seeds


def voronoi_parcels(vertices: DataFrame, edges: DataFrame, n: int, first: int = 0) -> DataFrame:
    """(vertex, parcel): the place in the seeds' list of the nearest seed along the edges."""
    spark = vertices.sparkSession
    seeds = farthest_seeds(vertices, edges, n, first)
    near = shortest_paths(edges, spark.createDataFrame([(s,) for s in seeds], "vertex bigint"))
    return near.join(F.broadcast(spark.createDataFrame(list(zip(seeds, range(len(seeds)), strict=True)), "root bigint, parcel int")), "root").select("vertex", "parcel")


def kmedoids(distance: DataFrame, k: int, init: str | list[int] = "center", max_loops: int = 6, seed: int = 0) -> DataFrame:
    """(vertex, center): medoid clusters of a full distance table (src, dst, d).

    Starts from the k most central vertices, k random ones or given ones; alternates
    the nearest centre of each vertex and the member with least total distance to its
    cluster, until no label changes.
    """
    spark = distance.sparkSession
    distance = settle(distance)
    if isinstance(init, list):
        centers = spark.createDataFrame([(c,) for c in init], "center bigint")
    elif init == "random":
        centers = distance.select(F.col("src").alias("center")).distinct().orderBy(F.xxhash64(F.lit(seed), "center")).limit(k)
    else:
        share = distance.withColumn("s", F.col("d") / F.sum("d").over(Window.partitionBy("src")))
        centers = share.groupBy(F.col("dst").alias("center")).agg(F.sum("s").alias("v")).orderBy("v", "center").limit(k).select("center")
    old = None
    for _ in range(max_loops):
        near = distance.join(F.broadcast(centers), distance["dst"] == F.col("center"))
        labels = settle(near.groupBy(F.col("src").alias("vertex")).agg(F.min(F.struct("d", "center")).alias("m")).select("vertex", F.col("m.center").alias("center")))
        if old is not None and labels.join(old, ["vertex", "center"], "left_anti").isEmpty():
            break
        old = labels
        inside = distance.join(labels.select(F.col("vertex").alias("src"), "center"), "src").join(labels.select(F.col("vertex").alias("dst"), F.col("center").alias("c2")), "dst").where("center = c2")
        cost = inside.groupBy("center", F.col("src").alias("v")).agg(F.sum("d").alias("cost"))
        centers = settle(cost.groupBy("center").agg(F.min(F.struct("cost", "v")).alias("m")).select(F.col("m.v").alias("center")))
    return labels


def cluster_cost(distance: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the total distance of vertices from their centres."""
    return distance.join(labels.select(F.col("vertex").alias("src"), F.col("center").alias("dst")), ["src", "dst"]).agg(F.sum("d").alias("cost"))


def smooth_values(edges: DataFrame, values: DataFrame, width: float, doubled_diagonal: bool = True) -> DataFrame:
    """(vertex, value) under heat-kernel smoothing of ``values`` along edges (src, dst, w), self loops of length 0 included.

    Number and size of the steps follow from the median edge length (self loops count);
    the weight of a vertex itself is 2, or 1 without ``doubled_diagonal``.
    """
    if width <= 0:
        return values
    loops = values.select(F.col("vertex").alias("src"), F.col("vertex").alias("dst"), F.lit(0.0).alias("w"))
    full = settle(edges.select("src", "dst", "w").where("src <> dst").unionByName(loops))
    m = (full.agg(F.median("w")).first()[0] or 0.0) / 6
    if m <= 0:
        return values
    steps = max(1, round(width * width / (m * m)))
    sigma2 = width * width / steps
    kernel = settle(full.select("src", "dst", F.when(F.col("src") == F.col("dst"), 2.0 if doubled_diagonal else 1.0).otherwise(F.exp(-F.col("w") * F.col("w") / (2 * sigma2))).alias("k")))
    for i in range(steps):
        values = kernel.join(values.withColumnRenamed("vertex", "dst"), "dst").groupBy(F.col("src").alias("vertex")).agg((F.sum(F.col("k") * F.col("value")) / F.sum("k")).alias("value"))
        values = settle(values) if i % 4 == 3 or i == steps - 1 else values
    return values


def smooth_structures(values: DataFrame, meshes: dict, width: float, doubled_diagonal: bool = True) -> DataFrame:
    """(structure, vertex, feature, value): values smoothed on the surfaces given by structure, others as they are.

    A surface is smoothed on the part of it that has values; that none of the surfaces
    is among the values is an error.
    """
    from functools import reduce

    from meshlake.operators.mesh import edges as mesh_edges

    here = {r["structure"] for r in values.select("structure").distinct().collect()} & set(meshes)
    if not here:
        raise ValueError("no values on the surfaces given")
    out = [values.where(~F.col("structure").isin(list(here))).select("structure", "vertex", "feature", "value")]
    for name in sorted(here):
        part = values.where(F.col("structure") == name)
        inside = part.select("vertex").distinct()
        near = mesh_edges(meshes[name], weight="distance")
        near = settle(near.join(inside.withColumnRenamed("vertex", "src"), "src", "left_semi").join(inside.withColumnRenamed("vertex", "dst"), "dst", "left_semi"))
        for r in part.select("feature").distinct().orderBy("feature").collect():
            one = smooth_values(near, part.where(F.col("feature") == r["feature"]).select("vertex", "value"), width, doubled_diagonal)
            out.append(one.select(F.lit(name).alias("structure"), "vertex", F.lit(r["feature"]).alias("feature"), "value"))
    return reduce(DataFrame.unionByName, out)


def flood(depth: np.ndarray, neighbours: list[np.ndarray], size: np.ndarray, min_depth: float = 0.0, min_size: float = 0.0, fill_ridge: bool = False) -> np.ndarray:
    """Watershed labels of the vertices of one component: 1.. in order of flooding, -1 on ridges.

    Vertices are flooded by ascending depth. One with no labelled neighbour opens a
    basin; one between two basins merges them if either is shallower than
    ``min_depth`` or smaller than ``min_size``, and is otherwise a ridge, or joins the
    smaller basin with ``fill_ridge``.
    """
    n = len(depth)
    label, parent = np.zeros(n, np.int64), [0]
    floor, extent = [0.0], [0.0]

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for v in np.lexsort((np.arange(n), depth)):
        mine = 0
        for u in neighbours[v]:
            if label[u] <= 0:
                continue
            other = root(label[u])
            if mine == 0:
                mine = other
            elif other != mine:
                shallow = min(depth[v] - floor[mine], depth[v] - floor[other]) < min_depth
                small = min(extent[mine], extent[other]) < min_size
                if shallow or small:
                    parent[other] = mine
                    extent[mine] += extent[other]
                    floor[mine] = min(floor[mine], floor[other])
                elif fill_ridge:
                    mine = mine if extent[mine] <= extent[other] else other
                else:
                    mine = -1
                    break
        if mine == 0:
            parent.append(len(parent))
            floor.append(depth[v])
            extent.append(0.0)
            mine = len(parent) - 1
        if mine > 0:
            extent[mine] += size[v]
        label[v] = mine
    roots = np.array([root(x) if x > 0 else x for x in label])
    found = {r: i + 1 for i, r in enumerate(sorted({r for r in roots if r > 0}))}
    return np.array([found.get(r, -1) for r in roots])


def watershed(vertices: DataFrame, edges: DataFrame, min_depth: float = 0.0, min_size: float = 0.0, fill_ridge: bool = False) -> DataFrame:
    """(vertex, component, parcel) by flooding ``vertices`` (vertex, depth, size).

    Flooding is sequential, so each connected component of the mesh is one task; a
    component of more than LOCAL_ROWS rows is refused.
    """
    comp = components(vertices, edges)
    rows = vertices.join(comp, "vertex").join(edges.groupBy(F.col("src").alias("vertex")).agg(F.sort_array(F.collect_list("dst")).alias("near")), "vertex", "left")
    largest = comp.groupBy("component").count().agg(F.max("count")).first()[0] or 0
    if largest > LOCAL_ROWS:
        raise ValueError(f"a component has {largest} vertices; at most {LOCAL_ROWS} can be flooded")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vertex")
        place = {v: i for i, v in enumerate(pdf["vertex"])}
        near = [np.array([place[u] for u in ([] if x is None else x) if u in place], np.int64) for x in pdf["near"]]
        out = flood(pdf["depth"].to_numpy(), near, pdf["size"].to_numpy(), min_depth, min_size, fill_ridge)
        return pd.DataFrame({"vertex": pdf["vertex"], "component": pdf["component"], "parcel": out})

    return rows.select("vertex", "component", "depth", "size", "near").groupBy("component").applyInPandas(run, "vertex long, component long, parcel int")


def watershed_parcels(vertices: DataFrame, edges: DataFrame, nparcels: int, min_size: float = 0.0, fill_ridge: bool = False, tries: int = 30) -> DataFrame:
    """The watershed at the least depth threshold, found by bisection, that gives at most ``nparcels``."""
    span = vertices.agg(F.max("depth") - F.min("depth")).first()[0] or 0.0
    low, high, best = 0.0, float(span) + 1e-9, None
    for _ in range(tries):
        mid = (low + high) / 2
        found = settle(watershed(vertices, edges, mid, min_size, fill_ridge))
        n = found.where("parcel > 0").select("component", "parcel").distinct().count()
        if n == nparcels:
            return found
        if n > nparcels:
            low = mid
        else:
            high, best = mid, found
    return best if best is not None else found
