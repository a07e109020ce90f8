"""Scalar and 3-vector geometry as column expressions. Vectors are tuples of three columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str) -> Vec:
    """Columns prefix_x, prefix_y, prefix_z."""
    return tuple(F.col(f"{prefix}_{c}") for c in "xyz")


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def scale(a: Vec, k) -> Vec:
    return tuple(x * k for x in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec) -> Vec:
    """The vector at length 1; null where its length is 0."""
    size = norm(a)
    return tuple(F.try_divide(x, size) for x in a)


def cart2spherical(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """(r, phi, theta): azimuth in -pi..pi and polar angle; the zero vector gives zeros."""
    r = F.sqrt(x * x + y * y + z * z)
    return r, F.atan2(y, x), F.when(r == 0, F.lit(0.0)).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(z, r)))))


def spherical2cart(r: Column, phi: Column, theta: Column) -> Vec:
    return r * F.cos(phi) * F.sin(theta), r * F.sin(phi) * F.sin(theta), r * F.cos(theta)


def rotation(theta: Column, axis: int) -> list[list[Column]]:
    """Rotation about an axis (0, 1, 2): with d1, d2 the two that follow it in the cycle 0, 1, 2, entry (d1, d2) is +sin."""
    d1, d2 = (axis + 1) % 3, (axis + 2) % 3
    m = [[F.lit(1.0) if i == j else F.lit(0.0) for j in range(3)] for i in range(3)]
    m[d1][d1] = m[d2][d2] = F.cos(theta)
    m[d1][d2], m[d2][d1] = F.sin(theta), -F.sin(theta)
    return m


def matmul(a, b) -> list[list[Column]]:
    return [[sum((a[i][k] * b[k][j] for k in range(1, 3)), a[i][0] * b[0][j]) for j in range(3)] for i in range(3)]


def euler2mat(phi: Column, theta: Column, psi: Column) -> list[list[Column]]:
    """Rotation matrix of Euler angles: turns about the axes 2, 1 and 2 by -phi, -theta and psi.

    Its last column, the image of z, is (cos phi sin theta, sin phi sin theta, cos theta).
    """
    return matmul(matmul(rotation(-phi, 2), rotation(-theta, 1)), rotation(psi, 2))


def mat2euler(m) -> tuple[Column, Column, Column]:
    """Angles (phi, theta, psi) of a rotation matrix, theta in 0..pi.

    Near 0 and pi the cosine of theta tells little of it; its sine, the length of two
    entries, does. phi is 0 where both are.
    """
    theta = F.atan2(F.hypot(m[0][2], m[1][2]), m[2][2])
    # adding 0.0 turns -0.0 into 0.0
    phi = F.atan2(m[1][2] + 0.0, m[0][2] + 0.0)
    t = euler2mat(phi, theta, F.lit(0.0))
    col = lambda a, j: [a[i][j] for i in range(3)]
    along = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    return phi, theta, F.atan2(along(col(t, 0), col(m, 1)), along(col(t, 1), col(m, 1)))


def clean_euler(phi: Column, theta: Column, psi: Column) -> tuple[Column, Column, Column]:
    """The same rotation by angles within -pi..pi, 0..pi and -pi..pi."""
    return mat2euler(euler2mat(phi, theta, psi))


def affine_mult(affine, v: Vec) -> Vec:
    """A point under a 4 x 4 affine given as numbers."""
    a = np.asarray(affine, float)
    return tuple(v[0] * float(a[i, 0]) + v[1] * float(a[i, 1]) + v[2] * float(a[i, 2]) + float(a[i, 3]) for i in range(3))


def tetrahedral_volume(p1: Vec, p2: Vec, p3: Vec) -> Column:
    """Signed volume of the tetrahedron of the origin and three points."""
    return dot(p1, cross(p2, p3)) / 6


def triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    return norm(cross(sub(b, a), sub(c, a))) / 2


def triangle_normal(a: Vec, b: Vec, c: Vec, flip: bool = False) -> Vec:
    n = unit(cross(sub(b, a), sub(c, a)))
    return scale(n, -1.0) if flip else n


def triangle_gradient(a: Vec, b: Vec, c: Vec, fa: Column, fb: Column, fc: Column) -> Vec:
    """Gradient within a triangle of the linear function with these corner values."""
    e1, e2 = sub(b, a), sub(c, a)
    g11, g12, g22 = dot(e1, e1), dot(e1, e2), dot(e2, e2)
    det = g11 * g22 - g12 * g12
    d1, d2 = fb - fa, fc - fa
    return add(scale(e1, F.try_divide(d1 * g22 - d2 * g12, det)), scale(e2, F.try_divide(d2 * g11 - d1 * g12, det)))


def align(v: Vec, reference: Vec) -> Vec:
    """The vector, turned round where it points away from the reference."""
    away = dot(v, reference) < 0
    return tuple(F.when(away, -x).otherwise(x) for x in v)


def make_perpendicular(radial: Vec, tangential: Vec) -> tuple[Vec, Vec, Vec]:
    """Three unit vectors: the radial, the tangential made perpendicular to it, and their product."""
    r = unit(radial)
    t = unit(sub(tangential, scale(r, dot(tangential, r))))
    return r, t, unit(cross(r, t))


def flatten_direction(a: Vec, b: Vec, c: Vec, direction: Vec) -> tuple[Column, Column]:
    """A direction in a triangle's own unit coordinates along its two first edges."""
    e1, e2, q = sub(b, a), sub(c, a), unit(direction)
    a1, a2, l1, l2, c12 = dot(q, e1), dot(q, e2), dot(e1, e1), dot(e2, e2), dot(e1, e2)
    v = F.try_divide(c12 * a1 - a2 * l1, c12 * c12 - l1 * l2)
    u = F.try_divide(a1 - v * c12, l1)
    size = F.sqrt(u * u + v * v)
    return F.try_divide(u, size), F.try_divide(v, size)


def point_segment(p: Vec, start: Vec, end: Vec) -> Column:
    """Distance of a point from a segment."""
    way = sub(end, start)
    t = F.try_divide(dot(way, sub(p, start)), dot(way, way))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))
    return norm(sub(p, add(start, scale(way, t))))


def line_triangle(origin: Vec, direction: Vec, a: Vec, b: Vec, c: Vec, one_sided: bool = False) -> tuple[Column, Column]:
    """Whether a line (or a ray) meets a triangle, and how many directions from its origin."""
    e1, e2 = sub(b, a), sub(c, a)
    h = cross(direction, e2)
    det = dot(e1, h)
    s = sub(origin, a)
    q = cross(s, e1)
    u, v, t = (F.try_divide(x, det) for x in (dot(s, h), dot(direction, q), dot(e2, q)))
    hit = F.coalesce((F.abs(det) > 1e-12) & (u >= -1e-5) & (v >= -1e-5) & (u + v <= 1 + 2e-5), F.lit(False))
    return (hit & (t >= 0) if one_sided else hit), t


def fibonacci_sphere(n: int) -> list[tuple[float, float, float]]:
    """Nearly even directions on the unit sphere."""
    golden = math.pi * (3 - math.sqrt(5))
    out = []
    for i in range(n):
        z = 1 - 2 * (i + 0.5) / n
        r = math.sqrt(max(0.0, 1 - z * z))
        out.append((r * math.cos(golden * i), r * math.sin(golden * i), z))
    return out
