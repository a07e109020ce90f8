"""Walks along a direction field on a triangle mesh, face by face, for all walkers at once.

A walker is a face with two coordinates (u, v): the point a + u (b - a) + v (c - a). In a
step it goes along its face's direction to the border it meets first and on into the
lowest-numbered other face there. It ends where it can go no further within its face,
or where there is no other face.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.functions import geometry as g
from meshlake.operators import mesh as ms
from meshlake.operators.graph import settle, unsettle

#: Steps below this length count as none.
LEAST = 1e-8


def flat_directions(mesh: ms.Mesh, directions: DataFrame) -> DataFrame:
    """(face, du, dv): directions (face, g_x, g_y, g_z) in the coordinates of their faces, of unit length."""
    u, v = g.flatten_direction(g.vec("a"), g.vec("b"), g.vec("c"), g.vec("g"))
    return ms.corners(mesh).join(directions, "face").select("face", u.alias("du"), v.alias("dv"))


def borders(mesh: ms.Mesh) -> DataFrame:
    """(face, side, next, p, q): beyond each side (1: ab, 2: ac, 3: bc) the other face, and the places there (0, 1, 2) of the side's ends.

    Sides that only one face has are left out; of several other faces the lowest counts.
    """
    ends = [(1, "a", "b"), (2, "a", "c"), (3, "b", "c")]
    sides = F.array(*[F.struct(F.lit(n).alias("side"), F.col(p).alias("p"), F.col(q).alias("q"), F.least(p, q).alias("low"), F.greatest(p, q).alias("high")) for n, p, q in ends])
    one = mesh.faces.select("face", "a", "b", "c", F.explode(sides).alias("s")).select("face", "a", "b", "c", "s.*")
    other = one.select(F.col("face").alias("next"), "low", "high", *[F.col(k).alias(f"n{k}") for k in "abc"])
    met = one.join(other, ["low", "high"]).where("face <> next")
    place = lambda c: F.when(F.col(c) == F.col("na"), 0).when(F.col(c) == F.col("nb"), 1).otherwise(2)
    best = met.groupBy("face", "side").agg(F.min(F.struct("next", place("p").alias("p"), place("q").alias("q"))).alias("m"))
    return best.select("face", "side", "m.*")


def field(mesh: ms.Mesh, directions: DataFrame) -> DataFrame:
    """(face, du, dv, beyond): all that a step needs of a face, in one row."""
    beyond = borders(mesh).groupBy("face").agg(F.map_from_entries(F.collect_list(F.struct("side", F.struct("next", "p", "q")))).alias("beyond"))
    return directions.select("face", "du", "dv").join(beyond, "face", "left")


def _step(walkers: DataFrame, faces: DataFrame) -> DataFrame:
    """Walkers (…, face, u, v, moved) one step on; ``moved`` is false for those that have ended."""
    keep = [c for c in walkers.columns if c not in ("face", "u", "v", "moved")]
    w = walkers.join(faces.withColumnRenamed("face", "f"), F.col("face") == F.col("f"), "left")
    u, v, du, dv = (F.col(c) for c in ("u", "v", "du", "dv"))

    def length(way: Column, speed: Column) -> Column:
        t = F.when(F.abs(speed) >= LEAST, way / speed)
        return F.when(t > LEAST, t)

    w = w.withColumn("t1", length(-v, dv)).withColumn("t2", length(-u, du)).withColumn("t3", length(1 - u - v, du + dv))
    w = w.withColumn("t", F.least("t1", "t2", "t3"))
    # the first side at the least length
    w = w.withColumn("side", F.when(F.col("t1") == F.col("t"), 1).when(F.col("t2") == F.col("t"), 2).when(F.col("t3") == F.col("t"), 3))
    w = w.withColumn("nu", u + du * F.col("t")).withColumn("nv", v + dv * F.col("t"))
    w = w.withColumn("n", F.try_element_at("beyond", F.col("side")))
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.col("side") == 1, F.col("nu")).otherwise(F.col("nv"))))
    w = w.withColumn("r", along)
    at = lambda k: F.when(F.col("n.p") == k, 1 - F.col("r")).when(F.col("n.q") == k, F.col("r")).otherwise(0.0)
    goes, crosses = F.col("moved") & F.col("side").isNotNull(), F.col("n").isNotNull()
    return w.select(
        *keep,
        F.when(goes & crosses, F.col("n.next")).otherwise(F.col("face")).alias("face"),
        F.when(goes & crosses, at(1)).when(goes, F.col("nu")).otherwise(u).alias("u"),
        F.when(goes & crosses, at(2)).when(goes, F.col("nv")).otherwise(v).alias("v"),
        (goes & crosses).alias("moved"),
    )


def surface_step(mesh: ms.Mesh, directions: DataFrame, walkers: DataFrame) -> DataFrame:
    """Walkers (…, face, u, v) after one step along ``directions`` (face, du, dv)."""
    return _step(walkers.withColumn("moved", F.lit(True)), field(mesh, directions)).drop("moved")


def track_to_maximum(mesh: ms.Mesh, directions: DataFrame, walkers: DataFrame, max_steps: int = 1000, at_once: int = 4) -> DataFrame:
    """Where walkers (…, face, u, v) end along ``directions`` (face, du, dv); more than ``max_steps`` are an error.

    ``at_once`` steps are taken before the walkers that still move are written down.
    """
    faces = settle(field(mesh, directions))
    moving, ended = settle(walkers.withColumn("moved", F.lit(True))), []
    for _ in range(0, max_steps, at_once):
        now = moving.where("moved")
        for _ in range(at_once):
            now = _step(now, faces)
        moving = settle(now)
        ended.append(moving.where("not moved").drop("moved"))
        if moving.where("moved").isEmpty():
            out = ended[0]
            for more in ended[1:]:
                out = out.unionByName(more)
            return out
    raise RuntimeError(f"no maximum within {max_steps} steps")


def ridge_values(mesh: ms.Mesh, directions: DataFrame, values: DataFrame) -> DataFrame:
    """(vertex, value): the mean of ``values`` (vertex, value) at the ridges that walks from a vertex end at.

    One walk starts at each corner of each face; one that ends where its own vertex
    still has a part does not count. A vertex without walks that count has null.
    """
    start = F.array(*[F.struct(F.col(k).alias("vertex"), F.lit(u).alias("u"), F.lit(v).alias("v")) for k, u, v in (("a", 0.0, 0.0), ("b", 1.0, 0.0), ("c", 0.0, 1.0))])
    walkers = mesh.faces.select("face", F.explode(start).alias("s")).select("s.*", "face")
    ends = track_to_maximum(mesh, directions, walkers).join(mesh.faces, "face")
    part = {"a": 1 - F.col("u") - F.col("v"), "b": F.col("u"), "c": F.col("v")}
    own = F.lit(False)
    total = F.lit(0.0)
    for k, share in part.items():
        ends = ends.join(values.select(F.col("vertex").alias(f"v_{k}"), F.col("value").alias(f"value_{k}")), F.col(k) == F.col(f"v_{k}"))
        own, total = own | ((F.col(k) == F.col("vertex")) & (share > LEAST)), total + share * F.col(f"value_{k}")
    mean = ends.where(~own).groupBy("vertex").agg(F.avg(total).alias("value"))
    return mesh.vertices.select("vertex").join(mean, "vertex", "left")


def from_ridge(mesh: ms.Mesh, depth: DataFrame, values: DataFrame, minimum: bool = False) -> DataFrame:
    """Values at the ridges of a vertex scalar (vertex, f), or at its valleys."""
    grad = ms.face_gradient(mesh, depth)
    if minimum:
        grad = grad.select("face", *[(-F.col(f"g_{c}")).alias(f"g_{c}") for c in "xyz"])
    return ridge_values(mesh, flat_directions(mesh, grad), values)
