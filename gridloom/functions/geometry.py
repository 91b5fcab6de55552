"""Geometry on the plane, the sphere and simplices, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.vectors import Vector, clamp, cross, dot, minus, norm, plus, times, total, unit, vector


def lonlat_to_xyz(lon: Column, lat: Column) -> Vector:
    """Degrees to a unit vector."""
    a, b = F.radians(lon), F.radians(lat)
    return [F.cos(a) * F.cos(b), F.sin(a) * F.cos(b), F.sin(b)]


def xyz_to_lonlat(p: Vector) -> tuple[Column, Column]:
    """A vector's longitude and latitude in degrees; longitude 0 on the axis."""
    return F.degrees(F.atan2(p[1], p[0])), F.degrees(F.asin(clamp(p[2] / norm(p))))


def great_circle(a: Vector, b: Vector, normalise: bool = True) -> Column:
    """Angle between two vectors in radians."""
    c = dot(a, b)
    return F.acos(clamp(c / (norm(a) * norm(b)) if normalise else c))


def rotation(angle: Column) -> list[Vector]:
    """Rows of the plane's rotation by ``angle``."""
    return [[F.cos(angle), -F.sin(angle)], [F.sin(angle), F.cos(angle)]]


def frame_from_angle(angle: Column) -> list[Vector]:
    """Orthonormal frame of the plane whose first vector points at ``angle``."""
    return [[F.cos(angle), F.sin(angle)], [-F.sin(angle), F.cos(angle)]]


def tangent_frame(p: Vector, north: Vector) -> list[Vector]:
    """East, north and up at a point of the sphere; null where the point is on the pole's axis."""
    up = unit(p)
    east = unit(cross(north, up))
    return [east, cross(up, east), up]


def geodesic_step(p: Vector, angle: Column, bearing: Column, north: Vector) -> Vector:
    """The unit vector at ``angle`` radians from ``p`` towards ``bearing`` (radians from north, clockwise)."""
    east, ahead, up = tangent_frame(p, north)
    way = plus(times(F.cos(bearing), ahead), times(F.sin(bearing), east))
    return plus(times(F.cos(angle), up), times(F.sin(angle), way))


def metric_from_ranges(frame: list[Vector], ranges: list[Column]) -> tuple[Column, list[Vector]]:
    """(log of the root determinant of G, inverse of G) of the metric with the given ranges along an orthonormal frame."""
    d = len(frame[0])
    log_root = -total([F.log(r) for r in ranges])
    inverse = [[total([r * r * v[i] * v[j] for v, r in zip(frame, ranges, strict=True)]) for j in range(d)] for i in range(d)]
    return log_root, inverse


def metric_distance(a: Vector, b: Vector, at_a: list[Vector], at_b: list[Vector]) -> Column:
    """Length of the segment in a metric that varies linearly from ``at_a`` to ``at_b``: 2/3 (c2^1.5 - c1^1.5) / (c2 - c1) with c the
    squared lengths of the segment in the two; the common value's root where they agree."""
    v = minus(b, a)
    c1, c2 = (total([v[i] * m[i][j] * v[j] for i in range(len(v)) for j in range(len(v))]) for m in (at_a, at_b))
    same = F.abs(c2 - c1) <= 1e-12 * F.greatest(c1, c2)
    return F.when(same, F.sqrt((c1 + c2) / 2)).otherwise(2.0 / 3.0 * (F.pow(c2, 1.5) - F.pow(c1, 1.5)) / (c2 - c1))


def widen_rectangle(lon: tuple[Column, Column], lat: tuple[Column, Column], margin: Column) -> tuple[Column, Column, Column, Column]:
    """(lon low, lon high, lat low, lat high) with a margin on every side, in the plane."""
    return lon[0] - margin, lon[1] + margin, lat[0] - margin, lat[1] + margin


def widen_rectangle_on_sphere(lon: tuple[Column, Column], lat: tuple[Column, Column], margin: Column) -> list[tuple[Column, Column]]:
    """Corners (lower left, lower right, upper right, upper left) moved outward along the diagonals by ``margin`` radians."""
    pole = [F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    corners = [(0, 0, 225), (1, 0, 135), (1, 1, 45), (0, 1, 315)]
    return [xyz_to_lonlat(geodesic_step(lonlat_to_xyz(lon[i], lat[j]), margin, F.lit(math.radians(bearing)), pole)) for i, j, bearing in corners]


class SimplexMap:
    """The affine map of a simplex: vertices as vectors of one length, one more of them than the simplex has dimensions (1 to 3)."""

    def __init__(self, vertices: list[Vector]):
        self.origin = vertices[0]
        self.edges = [minus(v, vertices[0]) for v in vertices[1:]]
        self.t = len(self.edges)
        if not 1 <= self.t <= 3:
            raise ValueError("simplices of 1 to 3 dimensions only")
        self.gram = [[dot(a, b) for b in self.edges] for a in self.edges]

    def gram_determinant(self) -> Column:
        g = self.gram
        if self.t == 1:
            return g[0][0]
        if self.t == 2:
            return g[0][0] * g[1][1] - g[0][1] * g[1][0]
        return total([g[0][i] * self._cofactor(0, i) for i in range(3)])

    def _cofactor(self, i: int, j: int) -> Column:
        g = self.gram
        if self.t == 1:
            return F.lit(1.0)
        if self.t == 2:
            return g[1 - i][1 - j] * (1.0 if i == j else -1.0)
        a, b = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
        minor = g[a[0]][b[0]] * g[a[1]][b[1]] - g[a[0]][b[1]] * g[a[1]][b[0]]
        return minor if (i + j) % 2 == 0 else -minor

    def volume(self) -> Column:
        """Length, area or volume."""
        return F.sqrt(F.greatest(self.gram_determinant(), F.lit(0.0))) / math.factorial(self.t)

    def inverse_gram(self) -> list[Vector]:
        d = self.gram_determinant()
        return [[self._cofactor(j, i) / d for j in range(self.t)] for i in range(self.t)]

    def gradients(self) -> list[Vector]:
        """Gradients of the barycentric coordinates, one for each vertex, in the embedding space."""
        inverse = self.inverse_gram()
        rest = [[total([self.edges[k][c] * inverse[k][i] for k in range(self.t)]) for c in range(len(self.origin))] for i in range(self.t)]
        return [[-total([g[c] for g in rest]) for c in range(len(self.origin))], *rest]

    def standard(self, x: Vector) -> Vector:
        """Least-squares coordinates of a point along the edges."""
        r = minus(x, self.origin)
        inverse = self.inverse_gram()
        along = [dot(e, r) for e in self.edges]
        return [total([inverse[i][j] * along[j] for j in range(self.t)]) for i in range(self.t)]

    def barycentric(self, x: Vector) -> Vector:
        s = self.standard(x)
        return [1.0 - total(s), *s]

    def at(self, s: Vector) -> Vector:
        """The point with standard coordinates ``s``."""
        return [self.origin[c] + total([s[i] * self.edges[i][c] for i in range(self.t)]) for c in range(len(self.origin))]

    def off(self, x: Vector) -> Column:
        """Distance of a point from the simplex's plane."""
        return norm(minus(x, self.at(self.standard(x))))

    def on_line_from(self, centre: Vector, x: Vector) -> Vector:
        """Where the line from ``centre`` through ``x`` meets the simplex's plane (one dimension less than the space: 2 or 3)."""
        way = minus(x, centre)
        normal = [-self.edges[0][1], self.edges[0][0]] if self.t == 1 else cross(self.edges[0], self.edges[1])
        return plus(centre, times(dot(normal, minus(self.origin, centre)) / dot(normal, way), way))


def packed(v: Vector) -> Column:
    return vector(*v)
