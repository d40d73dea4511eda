"""Kernels on whole shapes: repair of rings that cross themselves, unions as geometry, Voronoi cells."""

from __future__ import annotations

import numpy as np

from sylva.functions.overlay import crossings, edges_of
from sylva.functions.polygons import Ring, area, convex_hull


def crossing(p, q, r, s) -> tuple[float, float] | None:
    """Where two segments cross in their insides."""
    d = (q[0] - p[0]) * (s[1] - r[1]) - (q[1] - p[1]) * (s[0] - r[0])
    if d == 0:
        return None
    t = ((r[0] - p[0]) * (s[1] - r[1]) - (r[1] - p[1]) * (s[0] - r[0])) / d
    u = ((r[0] - p[0]) * (q[1] - p[1]) - (r[1] - p[1]) * (q[0] - p[0])) / d
    return (p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])) if 0 < t < 1 and 0 < u < 1 else None


def valid_parts(ring: Ring) -> list[Ring]:
    """Simple closed rings that a ring falls into: repeated points go, it is closed, and where it crosses or meets itself it is cut. Parts without an area go."""
    points = [p for i, p in enumerate(ring) if i == 0 or p != ring[i - 1]]
    if points and points[0] == points[-1]:
        points.pop()
    n = len(points)
    path: Ring = []
    for i in range(n):
        p, q = points[i], points[(i + 1) % n]
        met = [x for j in range(n) if j not in (i, (i + 1) % n, (i - 1) % n) and (x := crossing(p, q, points[j], points[(j + 1) % n]))]
        path += [p, *sorted((tuple(round(v, 12) for v in x) for x in met), key=lambda x: (x[0] - p[0]) ** 2 + (x[1] - p[1]) ** 2)]
    found, stack, place = [], [], {}
    for p in [*path, *path[:1]]:
        if p in place:  # a loop is closed
            loop = stack[place[p] :]
            for x in loop[1:]:
                del place[x]
            del stack[place[p] + 1 :]
            if len(loop) > 2 and area([*loop, loop[0]]) > 0:
                found.append([*loop, loop[0]])
        else:
            place[p] = len(stack)
            stack.append(p)
    return found


def union_parts(shapes: list[list[np.ndarray]]) -> list[Ring]:
    """The union of shapes as closed trapezoids that don't overlap."""
    edges, owner = edges_of(shapes)
    xs = np.unique(np.concatenate((edges[:, 0], edges[:, 2], crossings(edges)))) if len(edges) else np.zeros(0)
    out: list[Ring] = []
    for a, b in zip(xs[:-1], xs[1:], strict=True):
        live = (edges[:, 0] <= a) & (edges[:, 2] >= b)
        e, who = edges[live], owner[live]
        slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
        low, high = e[:, 1] + slope * (a - e[:, 0]), e[:, 1] + slope * (b - e[:, 0])
        order = np.argsort(low + high, kind="stable")
        low, high, who = low[order], high[order], who[order]
        inside = (np.cumsum(who[:, None] == np.arange(len(shapes)), axis=0) % 2 == 1).any(axis=1)
        first = None
        for k, held in enumerate(inside):
            if held and first is None:
                first = k
            elif not held and first is not None:
                ring = [(float(a), float(low[first])), (float(b), float(high[first])), (float(b), float(high[k])), (float(a), float(low[k]))]
                ring = [p for i, p in enumerate(ring) if p != ring[i - 1]]
                if len(ring) > 2:
                    out.append([*ring, ring[0]])
                first = None
    return out


def half_plane(ring: Ring, nx: float, ny: float, limit: float) -> Ring:
    """Part of an open convex ring where nx * x + ny * y <= limit."""
    out: Ring = []
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
        s, t = nx * x0 + ny * y0 - limit, nx * x1 + ny * y1 - limit
        if s <= 0:
            out.append((x0, y0))
        if (s < 0 < t) or (t < 0 < s):
            k = s / (s - t)
            out.append((x0 + k * (x1 - x0), y0 + k * (y1 - y0)))
    return out


def voronoi_cells(seeds: np.ndarray, bounds: tuple[float, float, float, float]) -> list[Ring | None]:
    """The closed cell of each seed clipped to the bounds; None where the cell is unbounded, as for seeds on the hull of all.

    Neighbours are taken by distance until the nearest that is left is too far to cut anything off.
    """
    hull = convex_hull([tuple(p) for p in seeds.tolist()])
    if hull is None:
        return [None] * len(seeds)
    corner, nxt = np.array(hull[:-1]), np.array(hull[1:])
    out: list[Ring | None] = []
    for x, y in seeds.tolist():
        twice = (nxt[:, 0] - corner[:, 0]) * (y - corner[:, 1]) - (nxt[:, 1] - corner[:, 1]) * (x - corner[:, 0])
        if (np.abs(twice) < 1e-12).any():
            out.append(None)
            continue
        x0, y0, x1, y1 = bounds
        ring: Ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
        away = (seeds[:, 0] - x) ** 2 + (seeds[:, 1] - y) ** 2
        for j in np.argsort(away, kind="stable"):
            if away[j] == 0:
                continue
            if not ring or away[j] > 4 * max((a - x) ** 2 + (b - y) ** 2 for a, b in ring):
                break
            u, v = seeds[j].tolist()
            ring = half_plane(ring, u - x, v - y, (u * u + v * v - x * x - y * y) / 2)
        out.append([*ring, ring[0]] if len(ring) > 2 else None)
    return out
