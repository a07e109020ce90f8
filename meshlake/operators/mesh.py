"""Triangle meshes and curves as two tables: vertices (vertex, x, y, z) and faces (face, a, b, c)."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlake.functions import geometry as g


@dataclass(frozen=True)
class Mesh:
    """A triangle mesh in space; ``flip`` turns its normals round."""

    vertices: DataFrame
    faces: DataFrame
    flip: bool = False

    def nvertices(self) -> int:
        return self.vertices.count()

    def nfaces(self) -> int:
        return self.faces.count()


def lattice(points: DataFrame, z: Column, width: int = 25) -> Mesh:
    """The mesh over rows numbered ``vertex`` on a grid ``width`` wide, with height z."""
    v = F.col("vertex")
    vertices = points.select(v, F.pmod(v, F.lit(width)).cast("double").alias("x"), F.floor(v / width).cast("double").alias("y"), z.cast("double").alias("z"))
    last = points.agg(F.max("vertex").alias("last"))
    corner = points.select("vertex").join(F.broadcast(last)).where((F.pmod(v, F.lit(width)) < width - 1) & (v + width + 1 <= F.col("last")))
    two = F.array(F.struct((2 * v).alias("face"), v.alias("a"), (v + 1).alias("b"), (v + width).alias("c")), F.struct((2 * v + 1).alias("face"), (v + 1).alias("a"), (v + width + 1).alias("b"), (v + width).alias("c")))
    return Mesh(vertices, corner.select(F.explode(two).alias("f")).select("f.*"))


def incidence(mesh: Mesh) -> DataFrame:
    """(vertex, face) for each corner."""
    return mesh.faces.select(F.explode(F.array("a", "b", "c")).alias("vertex"), "face")


def edges(mesh: Mesh, include_diagonal: bool = False, weight: str | float | None = None) -> DataFrame:
    """Directed vertex adjacency (src, dst): both ways, optionally with self loops.

    ``weight`` adds a column w: a constant, or ``distance`` for Euclidean lengths.
    """
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "a"), ("a", "c")]
    pairs += [("a", "a"), ("b", "b"), ("c", "c")] if include_diagonal else []
    out = mesh.faces.select(F.explode(F.array(*[F.struct(F.col(s).alias("src"), F.col(d).alias("dst")) for s, d in pairs])).alias("e")).select("e.*").distinct()
    if weight is None:
        return out
    if weight != "distance":
        return out.withColumn("w", F.lit(float(weight)))
    side = lambda k, p: mesh.vertices.select(F.col("vertex").alias(k), *[F.col(c).alias(f"{p}_{c}") for c in "xyz"])
    return out.join(side("src", "s"), "src").join(side("dst", "d"), "dst").select("src", "dst", g.norm(g.sub(g.vec("s"), g.vec("d"))).alias("w"))


def face_adjacency(mesh: Mesh) -> DataFrame:
    """(face, other, shared): faces with at least one vertex in common, each with itself as well."""
    one = incidence(mesh)
    return one.join(one.withColumnRenamed("face", "other"), "vertex").groupBy("face", "other").agg(F.count(F.lit(1)).alias("shared"))


def neighbour_faces(mesh: Mesh) -> DataFrame:
    """(face, neighbours): the faces across its edges, in order, padded with -1 to three."""
    near = face_adjacency(mesh).where("shared = 2").groupBy("face").agg(F.sort_array(F.collect_list("other")).alias("n"))
    padded = F.slice(F.concat(F.coalesce("n", F.array().cast("array<bigint>")), F.array_repeat(F.lit(-1).cast("bigint"), 3)), 1, 3)
    return mesh.faces.select("face").join(near, "face", "left").select("face", padded.alias("neighbours"))


def corners(mesh: Mesh, scalar: DataFrame | None = None) -> DataFrame:
    """Faces with the coordinates of their corners (a_x ... c_z), and corner values a_f, b_f, c_f of ``scalar`` (vertex, f)."""
    table = mesh.vertices if scalar is None else mesh.vertices.join(scalar, "vertex")
    names = [*"xyz", *([] if scalar is None else ["f"])]
    out = mesh.faces
    for k in "abc":
        out = out.join(table.select(F.col("vertex").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in names]), k)
    return out


def face_sizes(mesh: Mesh) -> DataFrame:
    return corners(mesh).select("face", g.triangle_area(*map(g.vec, "abc")).alias("size"))


def vertex_sizes(mesh: Mesh) -> DataFrame:
    """A third of the area of the faces around each vertex."""
    return incidence(mesh).join(face_sizes(mesh), "face").groupBy("vertex").agg((F.sum("size") / 3).alias("size"))


def face_normals(mesh: Mesh) -> DataFrame:
    n = g.triangle_normal(*map(g.vec, "abc"), flip=mesh.flip)
    return corners(mesh).select("face", *[x.alias(f"n_{c}") for x, c in zip(n, "xyz", strict=True)])


def vertex_normals(mesh: Mesh) -> DataFrame:
    """Unit sums of the unit normals around each vertex; faces without a normal count nothing."""
    total = incidence(mesh).join(face_normals(mesh), "face").groupBy("vertex").agg(*[F.sum(F.coalesce(f"n_{c}", F.lit(0.0))).alias(f"n_{c}") for c in "xyz"])
    return total.select("vertex", *[x.alias(f"n_{c}") for x, c in zip(g.unit(g.vec("n")), "xyz", strict=True)])


def volume(mesh: Mesh) -> DataFrame:
    """One row: the signed volume within a closed mesh."""
    v = F.sum(g.tetrahedral_volume(*map(g.vec, "abc")))
    return corners(mesh).agg((-v if mesh.flip else v).alias("volume"))


def face_gradient(mesh: Mesh, scalar: DataFrame) -> DataFrame:
    """Gradient on each face of a vertex scalar (vertex, f)."""
    grad = g.triangle_gradient(*map(g.vec, "abc"), *[F.col(f"{k}_f") for k in "abc"])
    return corners(mesh, scalar).select("face", *[x.alias(f"g_{c}") for x, c in zip(grad, "xyz", strict=True)])


def vertex_gradient(mesh: Mesh, scalar: DataFrame) -> DataFrame:
    """A third of the sum of the gradients of the faces around each vertex."""
    return incidence(mesh).join(face_gradient(mesh, scalar), "face").groupBy("vertex").agg(*[(F.sum(f"g_{c}") / 3).alias(f"g_{c}") for c in "xyz"])


def closed(mesh: Mesh) -> DataFrame:
    """One row: whether no edge belongs to one face alone."""
    ends = [("a", "b"), ("b", "c"), ("c", "a")]
    e = mesh.faces.select(F.explode(F.array(*[F.struct(F.least(s, d).alias("s"), F.greatest(s, d).alias("d")) for s, d in ends])).alias("e")).groupBy("e").count()
    return e.agg((F.coalesce(F.sum((F.col("count") == 1).cast("int")), F.lit(0)) == 0).alias("closed"))


def submesh(mesh: Mesh, keep: DataFrame) -> Mesh:
    """The mesh of the vertices of ``keep`` (vertex, position), numbered anew by position; faces need all corners."""
    old = keep.select("vertex", (F.row_number().over(Window.orderBy("position")) - 1).cast("bigint").alias("number"))
    vertices = mesh.vertices.join(old, "vertex").select(F.col("number").alias("vertex"), "x", "y", "z")
    faces = mesh.faces
    for k in "abc":
        faces = faces.join(old.select(F.col("vertex").alias(k), F.col("number").alias(f"new_{k}")), k)
    return Mesh(vertices, faces.select("face", *[F.col(f"new_{k}").alias(k) for k in "abc"]), mesh.flip)


def drop_isolated(mesh: Mesh) -> Mesh:
    return replace(mesh, vertices=mesh.vertices.join(incidence(mesh).select("vertex").distinct(), "vertex", "left_semi"))


def apply_affine(mesh: Mesh, affine) -> Mesh:
    """The mesh in the space of an affine (its inverse is applied); mirrored spaces turn the normals."""
    a = np.asarray(affine, float)
    v = g.affine_mult(np.linalg.inv(a), tuple(F.col(c) for c in "xyz"))
    vertices = mesh.vertices.select("vertex", *[x.alias(c) for x, c in zip(v, "xyz", strict=True)])
    return Mesh(vertices, mesh.faces, mesh.flip ^ bool(np.linalg.det(a[:3, :3]) < 0))


def inflate(mesh: Mesh, shift: float | None = None, volume_change: float | None = None) -> Mesh:
    """The mesh with vertices moved along their normals by ``shift``, or as far as changes the volume so much."""
    def moved(by):
        v = mesh.vertices.join(vertex_normals(mesh), "vertex", "left")
        return replace(mesh, vertices=v.select("vertex", *[(F.col(c) + F.coalesce(F.col(f"n_{c}"), F.lit(0.0)) * float(by)).alias(c) for c in "xyz"]))

    if shift is not None:
        return moved(shift)
    size = lambda m: float(volume(m).first()[0])
    start = size(mesh)
    want, inward = start + (volume_change or 0.0) * (1 if start >= 0 else -1), start < 0
    # the volume is a cubic of the shift: three more values fix it
    xs = np.array([-0.5, 0.0, 0.5, 1.0])
    cubic = np.polyfit(xs, [size(moved(x)) if x else start for x in xs], 3)
    cubic[-1] -= want
    roots = np.roots(cubic)
    real = sorted((float(r.real) for r in roots if abs(r.imag) < 1e-6), key=abs)
    if not real:
        raise ValueError(f"no shift gives the volume {want} ({'inward' if inward else 'outward'} normals)")
    return moved(real[0])


def line_intersections(mesh: Mesh, rays: DataFrame, one_sided: bool = False) -> DataFrame:
    """(ray, face, t): the faces that lines meet; ``rays`` (ray, o_x.., d_x..) is a small table and is broadcast up to a checked size."""
    hit, t = g.line_triangle(g.vec("o"), g.vec("d"), *map(g.vec, "abc"), one_sided=one_sided)
    if rays.count() > 10_000:
        raise ValueError("more than 10000 lines; use the grid index of meshlake.operators.spatial")
    return corners(mesh).join(F.broadcast(rays), F.lit(True)).where(hit).select("ray", "face", t.alias("t"))


def plane_crossings(mesh: Mesh, position=(0.0, 0.0, 0.0), normal=(0.0, 0.0, 1.0)) -> DataFrame:
    """(face, u, v, x, y, z): where a plane cuts the edges (u, v) of faces, two rows a face."""
    off = lambda k: sum((F.col(f"{k}_{c}") - float(p)) * float(n) for c, p, n in zip("xyz", position, normal, strict=True))
    rows = []
    for s, d in (("a", "b"), ("b", "c"), ("c", "a")):
        fs, fd = off(s), off(d)
        t = F.try_divide(fs, fs - fd)
        place = [(F.col(f"{s}_{c}") + (F.col(f"{d}_{c}") - F.col(f"{s}_{c}")) * t).alias(c) for c in "xyz"]
        rows.append(F.when((fs < 0) != (fd < 0), F.struct(F.least(s, d).alias("u"), F.greatest(s, d).alias("v"), *place)))
    cut = corners(mesh).select("face", F.explode(F.array(*rows)).alias("e")).where("e is not null")
    return cut.select("face", "e.*")


def layer_wedges(lower: Mesh, upper: Mesh) -> DataFrame:
    """Volume between two surfaces of the same faces, for each face: three tetrahedra."""
    low, up = corners(lower), corners(upper).select("face", *[F.col(f"{k}_{c}").alias(f"u{k}_{c}") for k in "abc" for c in "xyz"])
    both = low.join(up, "face")
    ref = g.vec("ua")
    part = lambda *names: F.abs(g.tetrahedral_volume(*[g.sub(g.vec(n), ref) for n in names]))
    return both.select("face", "a", "b", "c", (part("a", "b", "c") + part("ub", "uc", "b") + part("uc", "b", "c")).alias("volume"))


def layer_vertex_wedges(lower: Mesh, upper: Mesh) -> DataFrame:
    """A third of the wedges around each vertex."""
    w = layer_wedges(lower, upper)
    return w.select(F.explode(F.array("a", "b", "c")).alias("vertex"), "volume").groupBy("vertex").agg((F.sum("volume") / 3).alias("volume"))


def gyral_bias(lower: Mesh, upper: Mesh, curvature: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Wedge volume over vertex area, in units of its mean over flat vertices in use.

    ``curvature`` (vertex, curvature, use); null outside the vertices in use.
    """
    ratio = layer_vertex_wedges(lower, upper).join(vertex_sizes(upper), "vertex").join(curvature, "vertex").withColumn("ratio", F.try_divide("volume", "size"))
    flat = ratio.agg(F.avg(F.when(F.col("use") & (F.abs("curvature") < threshold), F.col("ratio"))).alias("flat"))
    return ratio.join(F.broadcast(flat)).select("vertex", F.when(F.col("use"), F.try_divide("ratio", "flat")).alias("bias"))


def smooth_step(mesh: Mesh, step: Column | float, steps: DataFrame | None = None) -> Mesh:
    """Each vertex moved by ``step`` towards the mean of its neighbours; ``steps`` (vertex, step) instead sets it for each."""
    near = edges(mesh).join(mesh.vertices.withColumnRenamed("vertex", "dst"), "dst").groupBy(F.col("src").alias("vertex")).agg(*[F.avg(c).alias(f"m_{c}") for c in "xyz"])
    joined = mesh.vertices.join(near, "vertex", "left")
    if steps is not None:
        joined, step = joined.join(steps, "vertex", "left"), F.coalesce(F.col("step"), F.lit(0.0))
    else:
        step = F.lit(float(step))
    return replace(mesh, vertices=joined.select("vertex", *[F.when(F.col(f"m_{c}").isNull(), F.col(c)).otherwise(step * F.col(f"m_{c}") + (1 - step) * F.col(c)).alias(c) for c in "xyz"]))


def expand_steps(mesh: Mesh, step: float) -> DataFrame:
    """(vertex, step): the step that undoes the shrinking of one smoothing step, by how much normals vary around a vertex."""
    vn = vertex_normals(mesh).select("vertex", *[F.col(f"n_{c}").alias(f"v_{c}") for c in "xyz"])
    near = incidence(mesh).join(face_normals(mesh), "face").join(vn, "vertex")
    q = near.groupBy("vertex").agg(F.avg(1 - F.pow(g.dot(g.vec("n"), g.vec("v")), 2)).alias("q"))
    return q.select("vertex", F.coalesce(F.try_divide(F.lit(-float(step)), 2 * step * F.col("q") + 1), F.lit(-float(step))).alias("step"))


def smooth(mesh: Mesh, nsteps: int, step: float = 0.5, expand: float | None = None, settle=None) -> Mesh:
    """``nsteps`` of shrinking and expanding; ``expand`` 0 leaves the expanding out. ``settle`` writes a table down between steps."""
    for _ in range(nsteps):
        mesh = smooth_step(mesh, step)
        if expand is None:
            mesh = smooth_step(mesh, 0.0, expand_steps(mesh, step))
        elif expand:
            mesh = smooth_step(mesh, expand)
        if settle is not None:
            mesh = replace(mesh, vertices=settle(mesh.vertices))
    return drop_isolated(mesh)
