"""Polygon kernels that column expressions can't express, as numpy and plain Python over Arrow batches.

Rings are lists of (x, y). The kernels are pure functions; apply_kernel() runs one over a column of rings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sylva.functions.overlay import covered_area

Ring = list[tuple[float, float]]


def area(ring: Ring) -> float:
    return abs(sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def simplify(ring: Ring, tolerance: float) -> Ring:
    """Douglas-Peucker on a closed ring, cut at its first vertex and the one farthest from it. At least a triangle stays."""
    if len(ring) < 5:
        return ring
    far = max(range(len(ring)), key=lambda i: (ring[i][0] - ring[0][0]) ** 2 + (ring[i][1] - ring[0][1]) ** 2)
    keep = {0, far, len(ring) - 1}
    stack = [(0, far), (far, len(ring) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        (ax, ay), (bx, by) = ring[a], ring[b]
        length = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5

        def off(i: int) -> float:
            x, y = ring[i]
            if length == 0:
                return ((x - ax) ** 2 + (y - ay) ** 2) ** 0.5  # noqa: B023
            return abs((bx - ax) * (ay - y) - (ax - x) * (by - ay)) / length  # noqa: B023

        worst = max(range(a + 1, b), key=off)
        if off(worst) > tolerance:
            keep.add(worst)
            stack += [(a, worst), (worst, b)]
    out = [ring[i] for i in sorted(keep)]
    return out if len(set(out)) >= 3 else ring


def convex_hull(points: Ring) -> Ring | None:
    """Closed hull, anticlockwise; None for fewer than three points that aren't on a line."""
    points = sorted(set(points))

    def half(seq: Ring) -> Ring:
        out: Ring = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    low, high = half(points), half(points[::-1])
    hull = low[:-1] + high[:-1]
    return hull + hull[:1] if len(hull) > 2 else None


def clip_convex(subject: Ring, clip: Ring) -> Ring:
    """Part of a convex ring inside an anticlockwise convex one."""
    for (ax, ay), (bx, by) in zip(clip, clip[1:] + clip[:1], strict=True):
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in subject]
        out: Ring = []
        for i, (x, y) in enumerate(subject):
            j = i - 1
            if (side[i] >= 0) != (side[j] >= 0):
                t = side[j] / (side[j] - side[i])
                out.append((subject[j][0] + t * (x - subject[j][0]), subject[j][1] + t * (y - subject[j][1])))
            if side[i] >= 0:
                out.append((x, y))
        subject = out
        if not subject:
            break
    return subject


def polygon_iou(a: Ring, b: Ring) -> float:
    """Of two closed rings."""
    column = lambda r: pa.array([[{"x": x, "y": y} for x, y in r]], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    return float(iou_batch(column(a), column(b))[0])


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rings, sizes) of a column of closed rings: (n, most, 2) with the closing vertex left out and the last one repeated."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    points = column.flatten()
    xy = np.stack([points.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1) if len(points) else np.zeros((1, 2))
    first = np.cumsum(sizes) - sizes
    count = np.maximum(sizes - 1, 0)
    at = np.minimum(np.arange(max(count.max(initial=0), 1)), np.maximum(count[:, None] - 1, 0)) + first[:, None]
    return xy[np.minimum(at, len(xy) - 1)], count


def convex_rings(rings: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which rings turn one way at every vertex, and once round in all."""
    at = np.arange(rings.shape[1])
    take = lambda i: np.take_along_axis(rings, np.broadcast_to(i, rings.shape[:2])[..., None], axis=1)
    a = rings - take(np.where(at == 0, np.maximum(count - 1, 0)[:, None], np.maximum(at - 1, 0)))
    b = take(np.where(at + 1 < count[:, None], np.minimum(at + 1, rings.shape[1] - 1), 0)) - rings
    real = at < count[:, None]
    cross = np.where(real, a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0], 0)
    turned = np.where(real, np.arctan2(cross, (a * b).sum(axis=2)), 0).sum(axis=1)
    return ((cross >= 0).all(axis=1) | (cross <= 0).all(axis=1)) & (np.abs(turned) < 7)


def signed_areas(rings: np.ndarray) -> np.ndarray:
    moved = rings - rings[:, :1]
    nxt = np.roll(moved, -1, axis=1)
    return (moved[..., 0] * nxt[..., 1] - nxt[..., 0] * moved[..., 1]).sum(axis=1) / 2


def clip_batch(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """Parts of convex rings inside anticlockwise convex ones, pair by pair; repeated vertices cut nothing off."""
    for k in range(clip.shape[1]):
        p, q = clip[:, k], clip[:, (k + 1) % clip.shape[1]]
        d = q - p
        side = d[:, None, 0] * (subject[..., 1] - p[:, None, 1]) - d[:, None, 1] * (subject[..., 0] - p[:, None, 0])
        before, last = np.roll(subject, 1, axis=1), np.roll(side, 1, axis=1)
        inside = side >= 0
        cross = inside != (last >= 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            point = before + (last / (last - side))[..., None] * (subject - before)
        both = np.stack((np.where(cross[..., None], point, 0), subject), axis=2).reshape(len(subject), -1, 2)
        keep = np.stack((cross, inside), axis=2).reshape(len(subject), -1)
        order = np.argsort(~keep, axis=1, kind="stable")[:, : max(int(keep.sum(axis=1).max(initial=0)), 1)]
        count = keep.sum(axis=1)
        order = np.where(np.arange(order.shape[1]) < count[:, None], order, np.take_along_axis(order, np.maximum(count - 1, 0)[:, None], axis=1))
        subject = np.take_along_axis(both, order[..., None], axis=1)
        subject = np.where((count > 0)[:, None, None], subject, 0)
    return subject


def iou_batch(a: pa.Array, b: pa.Array) -> np.ndarray:
    """IoU of the rings of two columns, row by row: convex rings all at once, others by slabs."""
    (p, n), (q, m) = padded(a), padded(b)
    areas = signed_areas(p), signed_areas(q)
    q = np.where((areas[1] < 0)[:, None, None], q[:, ::-1], q)
    convex = convex_rings(p, n) & convex_rings(q, m)
    common = np.zeros(len(p))
    if convex.any():
        common[convex] = np.abs(signed_areas(clip_batch(p[convex], q[convex])))
    for i in np.flatnonzero(~convex):
        common[i] = covered_area([p[i]], [[q[i]]])  # repeated vertices make edges without length
    union = np.abs(areas[0]) + np.abs(areas[1]) - common
    return np.where(union > 0, common / np.where(union > 0, union, 1), 0.0)


def decode_rle(counts: list[int], height: int, width: int) -> np.ndarray:
    """Mask of run lengths that begin with zeros and go down the columns."""
    values = np.repeat(np.arange(len(counts)) % 2, counts)
    return values.astype(bool).reshape(width, height).T


# Neighbours in a circle, as (row, col) steps.
AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def trace(mask: np.ndarray, start: tuple[int, int], came: int) -> list[tuple[int, int]]:
    """Border of the region at start by walking round it; came: the direction of a neighbour outside."""
    inside = lambda r, c: 0 <= r < mask.shape[0] and 0 <= c < mask.shape[1] and mask[r, c]
    at, look, path, first = start, came, [start], None
    while True:
        for k in range(1, 9):
            d = (look + k) % 8
            r, c = at[0] + AROUND[d][0], at[1] + AROUND[d][1]
            if inside(r, c):
                break
        else:
            return path
        if (at, d) == first:
            return path[:-1]
        first = first or (at, d)
        at, look = (r, c), (d + 4) % 8
        path.append(at)


def label(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """Number of the connected region of each set pixel, from 1."""
    out, n = np.zeros(mask.shape, np.int64), 0
    steps = AROUND if diagonal else AROUND[::2]
    for r, c in zip(*np.nonzero(mask), strict=True):
        if out[r, c]:
            continue
        n += 1
        stack = [(r, c)]
        out[r, c] = n
        while stack:
            y, x = stack.pop()
            for dy, dx in steps:
                v, u = y + dy, x + dx
                if 0 <= v < mask.shape[0] and 0 <= u < mask.shape[1] and mask[v, u] and not out[v, u]:
                    out[v, u] = n
                    stack.append((v, u))
    return out


def contours(mask: np.ndarray, min_points: int = 4) -> list[Ring]:
    """Outer borders of the regions of a mask, and the borders of their holes, each a closed ring of pixel places (col, row).

    Points on a straight run are left out. Borders of fewer than min_points pixels are dropped.
    """
    mask = np.asarray(mask, bool)
    rows, cols = (np.flatnonzero(mask.any(axis=k)) for k in (1, 0))
    if not len(rows):
        return []
    top, left = int(rows[0]), int(cols[0])
    mask = mask[top : rows[-1] + 1, left : cols[-1] + 1]  # what lies outside takes no part in a border
    starts = []
    regions = label(mask, True)
    for n in range(1, regions.max(initial=0) + 1):
        r, c = np.argwhere(regions == n)[0]
        starts.append(((int(r), int(c)), 4))
    padded = np.pad(~mask, 1, constant_values=True)
    holes = label(padded, False)
    outside = holes[0, 0]
    for n in range(1, holes.max() + 1):
        if n != outside:
            r, c = np.argwhere(holes == n)[0] - 1
            starts.append(((int(r) - 1, int(c)), 2))  # the pixel above the hole's first; the hole is below it
    out = []
    for start, came in starts:
        path = trace(mask, start, came)
        if len(path) < min_points:
            continue
        corners = [p for o, p, q in zip(path[-1:] + path[:-1], path, path[1:] + path[:1], strict=True) if (p[0] - o[0], p[1] - o[1]) != (q[0] - p[0], q[1] - p[1])]
        ring = [(float(c + left), float(r + top)) for r, c in corners]
        out.append(ring + ring[:1])
    return out


RING = "array<struct<x:double,y:double>>"


def rings_of(column: pa.Array) -> Iterator[Ring]:
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_pylist()
    points = column.flatten()
    xs, ys = (points.field(k).to_pylist() for k in (0, 1))
    at = 0
    for n in sizes:
        yield list(zip(xs[at : at + n], ys[at : at + n], strict=True))
        at += n


def as_structs(ring: Ring | None) -> list[dict] | None:
    return None if ring is None else [{"x": x, "y": y} for x, y in ring]


def apply_kernel(df: DataFrame, column: str, kernel: Callable[[Ring], Ring | None], out: str = "ring") -> DataFrame:
    """df with a ring column `out`: the kernel's result for each ring of `column`, batch by batch."""
    names = [c for c in df.columns if c != out]
    at = names.index(column) if column in names else None
    source = df.select(*names) if at is not None else df.select(*names, column)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in names)
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings = batch.column(batch.schema.get_field_index(column))
            made = pa.array([as_structs(kernel(r)) for r in rings_of(rings)], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], made], names=[*names, out])

    return source.mapInArrow(run, f"{kinds}, `{out}` {RING}")
