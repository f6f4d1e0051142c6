"""The surface in a 2 x 2 x 2 cell of voxels: triangles between the middles of the cell's edges, derived from its geometry.

The code of a cell (``raster.CORNER_WEIGHTS``) tells which of its corners are foreground. Where an edge joins a corner
inside with one outside, the surface crosses its middle; on each face the crossings are joined so that every corner
inside is cut off by itself, and the segments close to loops. A loop is cut into triangles in the way with the
least total area, of equals the first; each triangle stands for its normal, as long as its area.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewright.operators.raster import CORNER_WEIGHTS

CORNERS = list(product((0, 1), repeat=3))


def _crossings(inside: set[tuple]) -> dict[tuple, list[tuple]]:
    """The two neighbours on its loop of each crossing; crossings are middles of edges, in half units."""
    near: dict[tuple, list[tuple]] = {}
    for axis, side in product(range(3), (0, 1)):
        u, v = (a for a in range(3) if a != axis)

        def corner(a: int, b: int) -> tuple:
            c = [0, 0, 0]
            c[axis], c[u], c[v] = side, a, b
            return tuple(c)

        ring = [corner(0, 0), corner(0, 1), corner(1, 1), corner(1, 0)]
        cut = [tuple(p + q for p, q in zip(ring[i], ring[(i + 1) % 4])) if (ring[i] in inside) != (ring[(i + 1) % 4] in inside) else None for i in range(4)]
        if None not in cut:  # two opposite corners: each is cut off by itself
            joined = [(cut[i - 1], cut[i]) for i in range(4) if ring[i] in inside]
        else:
            met = [c for c in cut if c]
            joined = [tuple(met)] if met else []
        for a, b in joined:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    return near


def _loops(near: dict[tuple, list[tuple]]) -> list[list[tuple]]:
    loops, left = [], set(near)
    while left:
        loop = [min(left)]
        while True:
            left.discard(loop[-1])
            step = [n for n in near[loop[-1]] if n in left]
            if not step:
                break
            loop.append(min(step))
        loops.append(loop)
    return loops


def _triangles(loop: tuple[tuple, ...]) -> tuple[float, tuple[tuple, ...]]:
    """(area, triangles) of the cut of a loop with the least area."""
    if len(loop) < 3:
        return 0.0, ()
    best = None
    for k in range(1, len(loop) - 1):  # the triangle on the side from the first to the last point
        tri = (loop[0], loop[k], loop[-1])
        left, right = _triangles(loop[: k + 1]), _triangles(loop[k:])
        total = round(left[0] + right[0] + float(np.linalg.norm(_normal(tri))), 9)
        if best is None or total < best[0]:
            best = (total, (*left[1], tri, *right[1]))
    return best


def _normal(tri: tuple[tuple, ...]) -> np.ndarray:
    a, b, c = (np.array(p) / 2.0 for p in tri)
    return np.cross(b - a, c - a) / 2.0


@lru_cache
def cell_normals(code: int) -> tuple[tuple[float, float, float], ...]:
    """The normals (z, y, x) of the triangles of a cell, each as long as its area in a unit cell; up to their sign."""
    inside = {c for c in CORNERS if code & CORNER_WEIGHTS[c]}
    return tuple(tuple(_normal(t).tolist()) for loop in _loops(_crossings(inside)) for t in _triangles(tuple(loop))[1])


def cell_areas(spacing: tuple[float, float, float]) -> np.ndarray:
    """The area of the surface of each of the 256 cells at a spacing in z, y and x."""
    sz, sy, sx = spacing
    faces = np.array([sy * sx, sz * sx, sz * sy])
    return np.array([sum(float(np.linalg.norm(np.array(n) * faces)) for n in cell_normals(code)) for code in range(256)])


def area_table(spark: SparkSession, spacing: tuple[float, float, float]) -> DataFrame:
    """code, area: 256 rows."""
    return spark.createDataFrame([(k, float(a)) for k, a in enumerate(cell_areas(spacing))], "code int, area double")


def area_of(code: Column, spacing: tuple[float, float, float]) -> Column:
    """The area of a cell by its code; null outside of 0 to 255."""
    return F.get(F.array(*(F.lit(float(a)) for a in cell_areas(spacing))), code)
