"""Delaunay triangulation of integer points, exactly, in tiles.

A kernel sees the points of its tile alone. A triangle is final when the part of its circumcircle that lies in the box of all
points also lies in the tile: no point of another tile can be within. A point that final triangles surround is done. All
other triangles have their corners among the points that are left, so the next round does the same with those alone, in tiles
of twice the width, and leaves out what covers final triangles: that shows at the edges of final triangles that have one on
one side only, which go along. The last round has one tile. What is left of a tile lies along its border, so a kernel's points
grow with the square root of all points; where most points lie on one circle or are corners of the hull, they stay to the end.

Whether a triangle is final depends on its exact circle alone, so triangles of more than three points on a circle are final
together and tiles do not cross them.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.tables import settled

#: Points that a kernel of the first round is meant to take.
TILE_POINTS = 4000
#: Partitions at most that tiles are dealt to.
MOST_TASKS = 1000


def _turn(a: tuple[int, int], b: tuple[int, int], c: tuple[int, int]) -> int:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _inside(a: tuple[int, int], b: tuple[int, int], c: tuple[int, int], d: tuple[int, int]) -> bool:
    """Whether d is within the circle through a, b, c (counter-clockwise)."""
    rows = [(p[0] - d[0], p[1] - d[1]) for p in (a, b, c)]
    (ax, ay), (bx, by), (cx, cy) = rows
    a2, b2, c2 = (x * x + y * y for x, y in rows)
    return ax * (by * c2 - b2 * cy) - ay * (bx * c2 - b2 * cx) + a2 * (bx * cy - by * cx) > 0


class Mesh:
    """Triangles that grow by one point at a time inside a triangle that lies far enough out.

    Integer triangles within a box of side s have circumradii under s ** 3, so corners at s ** 4 take no part
    in any circle that matters. apex holds the third corner of the triangle to the left of each directed edge.
    """

    def __init__(self, points: list[tuple[int, int]]) -> None:
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        side = max(max(xs) - min(xs), max(ys) - min(ys), 2)
        far, cx, cy = 4 * side**4, min(xs), min(ys)
        n = len(points)
        self.x, self.y, self.n = [*xs, cx - 3 * far, cx + 3 * far, cx], [*ys, cy - 3 * far, cy - 3 * far, cy + 3 * far], n + 3
        self.apex: dict[int, int] = {}
        self.put(n, n + 1, n + 2)
        cell = max(1, int(side / max(1, math.sqrt(n))) * 4)
        for k in sorted(range(n), key=lambda k: ((row := ys[k] // cell), xs[k] if row % 2 == 0 else -xs[k])):
            self.add(k)

    def put(self, u: int, v: int, w: int) -> None:
        n, apex = self.n, self.apex
        apex[u * n + v], apex[v * n + w], apex[w * n + u] = w, u, v
        self.last = u, v, w

    def find(self, k: int) -> tuple[int, int, int]:
        """The triangle that point k lies in, by a walk from the last one."""
        n, apex, xs, ys = self.n, self.apex, self.x, self.y
        px, py = xs[k], ys[k]
        a, b, c = self.last
        ax, ay, bx, by = xs[a], ys[a], xs[b], ys[b]
        if (bx - ax) * (py - ay) < (by - ay) * (px - ax):
            a, b, c = b, a, apex[b * n + a]
            ax, ay, bx, by = bx, by, ax, ay
        while True:  # the point is not to the right of a, b
            cx, cy = xs[c], ys[c]
            if (cx - bx) * (py - by) < (cy - by) * (px - bx):
                a, b, c = c, b, apex[c * n + b]
                ax, ay = cx, cy
            elif (ax - cx) * (py - cy) < (ay - cy) * (px - cx):
                a, b, c = a, c, apex[a * n + c]
                bx, by = cx, cy
            else:
                return a, b, c

    def add(self, k: int) -> None:
        n, apex, xs, ys = self.n, self.apex, self.x, self.y
        px, py = xs[k], ys[k]
        a, b, c = self.find(k)
        todo = [(a, b), (b, c), (c, a)]
        while todo:
            u, v = todo.pop()
            w = apex.get(v * n + u)
            if w is not None:
                ax, ay, bx, by, cx, cy = xs[v] - px, ys[v] - py, xs[u] - px, ys[u] - py, xs[w] - px, ys[w] - py
                if (ax * ax + ay * ay) * (bx * cy - by * cx) + (bx * bx + by * by) * (cx * ay - cy * ax) + (cx * cx + cy * cy) * (ax * by - ay * bx) > 0:
                    del apex[v * n + u], apex[u * n + v]
                    todo += (u, w), (w, v)
                    continue
            apex[u * n + v], apex[v * n + k], apex[k * n + u] = k, u, v
        self.last = u, v, k

    def triangles(self) -> list[tuple[int, int, int]]:
        n = self.n
        return [(u, v, w) for e, w in self.apex.items() if (u := e // n) < w and u < (v := e % n)]


def triangles(points: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Corners of all triangles, counter-clockwise; those with a corner of the outer triangle stand for hull edges."""
    return Mesh(points).triangles() if len(points) > 1 else []


def circle(a: tuple[int, int], b: tuple[int, int], c: tuple[int, int]) -> tuple[float, float, float]:
    """Centre and radius, each the exact value rounded once: the same for any three points of a circle."""
    bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
    d, b2, c2 = 2 * (bx * cy - by * cx), bx * bx + by * by, cx * cx + cy * cy
    x, y = cy * b2 - by * c2, bx * c2 - cx * b2
    return (a[0] * d + x) / d, (a[1] * d + y) / d, math.sqrt((x * x + y * y) / (d * d))


def reached(circle: tuple[float, float, float], box: tuple[int, int, int, int]) -> tuple[float, float, float, float]:
    """The smallest rectangle around the part of a circle that lies in the box; an empty one if none does."""
    x, y, r = circle
    past = lambda v, low, high: max(low - v, v - high, 0.0)
    wide, high = (math.sqrt(max(r * r - d * d, 0.0)) * (1 + 1e-9) + 1e-6 for d in (past(y, box[1], box[3]), past(x, box[0], box[2])))
    return max(x - wide, box[0]), max(y - high, box[1]), min(x + wide, box[2]), min(y + high, box[3])


class Fans:
    """Where final triangles lie around points: from the edges (u, v) that have one to their left and none to their right."""

    def __init__(self, points: list[tuple[int, int]], rim: list[tuple[int, int]]) -> None:
        self.points, self.ways = points, defaultdict(list)
        for u, v in rim:  # at u they begin at the way to v, at v they end at the way to u
            self.ways[u].append((v, True))
            self.ways[v].append((u, False))

    def cover(self, p: int, q: int) -> bool:
        """Whether one lies right after the way from p to q, counter-clockwise: what the last way before it says."""
        x, y = self.points[p]
        qx, qy = self.points[q][0] - x, self.points[q][1] - y
        best = None
        for v, begins in self.ways.get(p, ()):
            vx, vy = self.points[v][0] - x, self.points[v][1] - y
            turn = vx * qy - vy * qx
            half = not (turn > 0 or (turn == 0 and vx * qx + vy * qy > 0))  # half a turn or more before q
            if best is None or half < best[0] or (half == best[0] and best[1] * vy - best[2] * vx > 0):
                best = half, vx, vy, begins
        return best is not None and best[3]


#: Rows: edges of final triangles; edges of them that have one on one side only; points (both ends alike) that are left.
EDGE, RIM, LEFT = range(3)


def tile(points: list[tuple[int, int]], rim: list[tuple[int, int]], final: Callable[[tuple, tuple, tuple], bool] | None) -> list[np.ndarray]:
    """Of a tile's sorted points, as pairs of their numbers: new EDGEs, RIM and points LEFT. rim: edges with a final
    triangle to their left; final: of three points, or None where all triangles are."""
    n, fans = len(points), Fans(points, rim)
    found, hull = [], []
    for t in triangles(points):
        if max(t) >= n:
            hull.append([k for k in t if k < n])
        elif not (rim and fans.cover(t[0], t[1])) and (final is None or final(*(points[k] for k in t))):
            found.append(t)
    new = np.array(found, np.int64).reshape(-1, 3)
    sides = np.concatenate([new[:, [0, 1]], new[:, [1, 2]], new[:, [2, 0]]])
    if final is None:
        edges = np.concatenate([sides, np.array([h for h in hull if len(h) == 2], np.int64).reshape(-1, 2)])
        return [np.unique(np.sort(edges, axis=1), axis=0), sides[:0], sides[:0]]
    every = np.concatenate([sides, np.array(rim, np.int64).reshape(-1, 2)])
    alone = every[~np.isin(every[:, 0] * n + every[:, 1], every[:, 1] * n + every[:, 0])]
    left = np.union1d(np.setdiff1d(np.arange(n), every), alone)
    return [np.unique(np.sort(sides, axis=1), axis=0), alone, np.stack([left, left], axis=1)]


SCHEMA = "kind int, ax long, ay long, bx long, by long"


def _kernel(size: int, box: tuple[int, int, int, int], whole: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        low, at = [b + k.as_py() * size for b, k in zip(box, key, strict=False)], [rows.column(c).to_numpy() for c in ("ax", "ay", "bx", "by")]
        alike = (at[0] == at[2]) & (at[1] == at[3])
        points = sorted(set(zip(at[0][alike].tolist(), at[1][alike].tolist(), strict=True)))
        number = {p: k for k, p in enumerate(points)}
        rim = [(number[u, v], number[x, y]) for u, v, x, y in zip(*(c[~alike].tolist() for c in at), strict=True)]

        def final(*corners: tuple[int, int]) -> bool:
            reach = reached(circle(*corners), box)
            return reach[0] >= low[0] and reach[1] >= low[1] and reach[2] < low[0] + size and reach[3] < low[1] + size

        made = tile(points, rim, None if whole else final)
        where, pairs = np.array(points, np.int64).reshape(-1, 2), np.concatenate(made)
        kinds = np.repeat(np.arange(len(made), dtype=np.int32), [len(m) for m in made])
        return pa.table([pa.array(kinds), *(pa.array(where[pairs[:, e], c]) for e in (0, 1) for c in (0, 1))], names=["kind", "ax", "ay", "bx", "by"])

    return run


def location_edges(points: DataFrame) -> DataFrame:
    """ax, ay, bx, by: Delaunay edges of the distinct points (x, y)."""
    points = settled(points.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct(), "spots")
    s = points.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).first()
    if s["n"] < 2:
        return points.sparkSession.createDataFrame([], "ax long, ay long, bx long, by long")
    box = (s["x0"], s["y0"], s["x1"], s["y1"])
    side = max(s["x1"] - s["x0"], s["y1"] - s["y0"]) + 1
    across = max(1, math.ceil(math.sqrt(s["n"] / TILE_POINTS)))
    size = -(-side // across)
    rows, found = points.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by")), None
    while True:
        # Ends of a rim lie in one tile, as its triangle does. A partition for each tile, as they are short and take long.
        tiled = rows.withColumn("tx", F.expr(f"(ax - {box[0]}) div {size}")).withColumn("ty", F.expr(f"(ay - {box[1]}) div {size}")).repartition(min(across * across, MOST_TASKS), "tx", "ty")
        made = settled(tiled.groupBy("tx", "ty").applyInArrow(_kernel(size, box, across == 1), SCHEMA), "tiles")
        edges = made.where(F.col("kind") == EDGE).drop("kind")
        found = edges if found is None else found.union(edges)
        if across == 1:
            return found.distinct()
        rows = made.where(F.col("kind") > EDGE).drop("kind")
        size, across = size * 2, -(-across // 2)
