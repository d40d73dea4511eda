"""Kernels over many boxes of one group in numpy: IoU of one box with those near it, and unions by strips.

Nothing here holds all pairs: each box is held against one slice of the others, in memory that grows with the boxes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

BOX = ("x0", "y0", "x1", "y1")


def edges(table: pa.Table, prefix: str = "") -> np.ndarray:
    """Boxes of a table as rows of x0, y0, x1, y1."""
    return np.stack([table[prefix + k].to_numpy().astype(np.float64) for k in BOX], axis=1) if table.num_rows else np.zeros((0, 4))


class NearBoxes:
    """Boxes in the order of one lower edge, so that those which can overlap a box are one slice."""

    def __init__(self, boxes: np.ndarray) -> None:
        spread = [np.mean(boxes[:, k + 2] - boxes[:, k]) / max(np.ptp(boxes[:, k]), 1e-300) if len(boxes) else 0.0 for k in (0, 1)]
        self.axis = int(spread[1] < spread[0])  # the axis whose slices are the shorter
        self.order = np.argsort(boxes[:, self.axis], kind="stable")
        columns = boxes[self.order].T.copy()
        self.x0, self.y0, self.x1, self.y1 = columns
        self.low = columns[self.axis]
        self.size = (self.x1 - self.x0) * (self.y1 - self.y0)
        # Short floats, from the lowest corner and with the upper edges moved out by more than their rounding, rule most boxes out.
        self.origin = np.array([np.min(columns[k], initial=np.inf) for k in (0, 1)] * 2) if len(boxes) else np.zeros(4)
        moved = columns - self.origin[:, None]
        self.blur = 1e-6 * float(np.max(np.abs(moved), initial=0.0))
        self.short = (moved + np.array([0.0, 0.0, self.blur, self.blur])[:, None]).astype(np.float32)
        self.wide = np.float32(2 * self.blur)
        self.short_size = (self.size * (1 - 1e-4)).astype(np.float32)
        self.reach = float(np.max(columns[self.axis + 2] - columns[self.axis], initial=0.0))

    def ious(self, box: np.ndarray, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(rows, IoU) of the boxes that cross `box` with an IoU of at least `least`.

        An IoU of t leaves lower edges apart by no more than (1 - t) / t of the box's own side.
        """
        low, high = box[self.axis], box[self.axis + 2]
        slack = 1e-9 * (abs(low) + abs(high))
        apart = (1 - least) / least * (high - low) if least > 0 else np.inf
        a, b = np.searchsorted(self.low, low - min(self.reach, apart) - slack), np.searchsorted(self.low, min(high, low + apart) + slack, "right")
        if least > 0:
            # IoU >= t just where (1 + t) * common >= t * (both areas).
            x0, y0, x1, y1 = self.short[:, a:b]
            left, low, right, high = (np.float32(v) for v in (box - self.origin))
            common = np.maximum(np.minimum(x1, right + self.wide) - np.maximum(x0, left), np.float32(0))
            common *= np.minimum(y1, high + self.wide) - np.maximum(y0, low)
            share = np.float32(least / (1 + least))
            own = np.float32((box[2] - box[0]) * (box[3] - box[1]) * (1 - 1e-4))
            at = np.flatnonzero(common >= (self.short_size[a:b] + own) * share) + a
            w, h = np.minimum(self.x1[at], box[2]) - np.maximum(self.x0[at], box[0]), np.minimum(self.y1[at], box[3]) - np.maximum(self.y0[at], box[1])
        else:  # boxes without an area cross others too, with an IoU of 0
            x0, y0, x1, y1 = (v[a:b] for v in (self.x0, self.y0, self.x1, self.y1))
            at = np.flatnonzero((x0 < box[2]) & (x1 > box[0]) & (y0 < box[3]) & (y1 > box[1]))
            w, h = (np.minimum(x1, box[2]) - np.maximum(x0, box[0]))[at], (np.minimum(y1, box[3]) - np.maximum(y0, box[1]))[at]
            at = at + a
        common = np.maximum(w, 0.0) * np.maximum(h, 0.0)
        union = (box[2] - box[0]) * (box[3] - box[1]) + self.size[at] - common
        value = np.where(union > 0, common / np.where(union > 0, union, 1.0), 0.0)
        if least > 0:
            keep = value >= least
            at, value = at[keep], value[keep]
        return self.order[at], value

    def best_of_many(self, boxes: np.ndarray, rank: np.ndarray, least: float, number: np.ndarray, row: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Fill in row and value, at their numbers, of the boxes whose best reaches `least`; returns where the others stand. Boxes go in runs that share a slice."""
        low, side = boxes[:, self.axis], boxes[:, self.axis + 2] - boxes[:, self.axis]
        slack = 1e-9 * (np.abs(low) + np.abs(low + side))
        apart = (1 - least) / least * side + slack
        order, own = np.argsort(low, kind="stable"), (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
        left, at, ranks = [], 0, rank[self.order]
        while at < len(order):
            part = order[at : at + 64]
            at += len(part)
            a, b = np.searchsorted(self.low, (low[part] - apart[part]).min()), np.searchsorted(self.low, (low[part] + apart[part]).max(), "right")
            few = max(1, 400_000 // max(1, b - a))
            for k in range(0, len(part), few):
                some = part[k : k + few]
                if a == b:
                    left += some.tolist()
                    continue
                x0, y0, x1, y1 = (c[:, None] for c in boxes[some].T)
                common = np.maximum(np.minimum(self.x1[a:b], x1) - np.maximum(self.x0[a:b], x0), 0.0)
                common *= np.maximum(np.minimum(self.y1[a:b], y1) - np.maximum(self.y0[a:b], y0), 0.0)
                union = own[some, None] + self.size[a:b] - common
                ratio = np.divide(common, union, out=np.zeros_like(common), where=union > 0)
                top = ratio.max(axis=1)
                best = np.where(ratio == top[:, None], ranks[a:b], np.iinfo(np.int64).max).argmin(axis=1)
                good = top >= least
                row[number[some[good]]], value[number[some[good]]] = self.order[a + best[good]], top[good]
                left += some[~good].tolist()
        return np.array(left, np.int64)


def best_boxes(boxes: np.ndarray, others: np.ndarray, rank: np.ndarray, steps: Sequence[float] = (0.8, 0.5, 0.0)) -> tuple[np.ndarray, np.ndarray]:
    """(row, IoU) of the best of the others for each box, -1 and 0 where none crosses it; equal ones go by rank.

    Slices are narrow at first: what reaches a step can't be beaten by what lies outside its slice.
    """
    near, row, value = NearBoxes(others), np.full(len(boxes), -1), np.zeros(len(boxes))
    left = np.arange(len(boxes))
    for least in steps:
        if least > 0:
            left = left[near.best_of_many(boxes[left], rank, least, left, row, value)]
    for i in left.tolist():
        at, found = near.ious(boxes[i])
        if len(at):
            top = found.max()
            at = at[found == top]
            row[i], value[i] = at[np.argmin(rank[at])], top
    return row, value


def held_boxes(outer: np.ndarray, inner: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows of outer, rows of inner) of the pairs where the common area is at least `share` of the inner box, which has an area."""
    x0, y0, x1, y1 = outer.T.copy()
    found = [np.zeros((2, 0), np.int64)]
    step = max(1, 200_000 // max(1, len(outer)))
    for at in range(0, len(inner), step):
        u0, v0, u1, v1 = (c[:, None] for c in inner[at : at + step].T)
        common = np.maximum(np.minimum(x1, u1) - np.maximum(x0, u0), 0.0)
        common *= np.maximum(np.minimum(y1, v1) - np.maximum(y0, v0), 0.0)
        area = (u1 - u0) * (v1 - v0)
        own, other = np.nonzero((common >= area * share * (1 - 1e-12)) & (area > 0))
        sure = common[own, other] / area[own, 0] >= share
        found.append(np.stack((other[sure], own[sure] + at)))
    return tuple(np.concatenate(found, axis=1))


def near_pairs(key: np.ndarray, boxes: np.ndarray, least: float, corner: tuple[float, float, float, float], height: float, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(smaller key, larger key, IoU) of the pairs with an IoU of `least` or more, which is above 0, whose reference point lies in `corner` (x0, y0 and the ends, which don't count).

    The reference point is the larger of the two lower corners. Boxes stand in each strip of y, of this height, that they touch, in
    order of x0, and are held against those that begin before they end, about `most` at a time; a pair counts in the strip of its reference point.
    """
    strip = lambda v: np.floor((np.clip(v, corner[1], corner[3]) - corner[1]) / height).astype(np.int64)
    low = strip(boxes[:, 1])
    times = np.maximum(strip(boxes[:, 3]) - low + 1, 0)
    row = np.repeat(np.arange(len(boxes)), times)
    line = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    order = np.lexsort((boxes[row, 0], line))
    row, line = row[order], line[order]
    x0, y0, x1, y1 = boxes[row].T.copy()
    if not len(row):
        return
    start = x0.min()
    span = 2 * (x1.max() - start) + 1
    place = line * span + (x0 - start)
    slack = 1e-9 * (abs(start) + float(place[-1]) + span)
    ends = np.maximum(np.searchsorted(place, np.minimum(place + (x1 - x0) + slack, (line + 1) * span - span / 4)), np.arange(1, len(row) + 1))
    own, size, share = key[row], (x1 - x0) * (y1 - y0), least / (1 + least) * (1 - 1e-9)
    counts = ends - np.arange(1, len(row) + 1)
    total = np.cumsum(counts)
    at = 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(total, total[at] - counts[at] + most, "right")))
        n = counts[at:to]
        a = np.repeat(np.arange(at, to), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(total[at:to] - n - (total[at] - counts[at]), n)
        at = to
        common = np.minimum(y1[a], y1[b]) - np.maximum(y0[a], y0[b])
        live = np.flatnonzero(common > 0)
        a, b, common = a[live], b[live], common[live]
        common *= np.minimum(x1[a], x1[b]) - x0[b]
        live = np.flatnonzero((common > 0) & (common >= (size[a] + size[b]) * share))
        a, b, common = a[live], b[live], common[live]
        value = common / (size[a] + size[b] - common)
        x, y = x0[b], np.maximum(y0[a], y0[b])
        sure = (value >= least) & (strip(y) == line[a]) & (x >= corner[0]) & (x < corner[2]) & (y >= corner[1]) & (y < corner[3])
        i, j = own[a[sure]], own[b[sure]]
        yield np.minimum(i, j), np.maximum(i, j), value[sure]


def box_union(boxes: np.ndarray) -> np.ndarray:
    """The union of boxes as boxes that don't overlap: strips between neighbouring x, cut into runs of y. Boxes without an area hold nothing."""
    boxes = boxes[(boxes[:, 0] < boxes[:, 2]) & (boxes[:, 1] < boxes[:, 3])]
    x0, y0, x1, y1 = boxes[np.argsort(boxes[:, 1], kind="stable")].T
    xs, out = np.unique(np.concatenate((x0, x1))), []
    for a, b in zip(xs[:-1], xs[1:], strict=True):
        live = (x0 <= a) & (x1 >= b)
        low, high = y0[live], y1[live]
        if len(low):
            high = np.maximum.accumulate(high)
            heads = np.flatnonzero(np.append(True, low[1:] > high[:-1]))
            tops = high[np.append(heads[1:], len(low)) - 1]
            out.append(np.stack((np.full(len(heads), a), low[heads], np.full(len(heads), b), tops), axis=1))
    return np.concatenate(out) if out else np.zeros((0, 4))


def take_greedily(pid: np.ndarray, preds: np.ndarray, conf: np.ndarray, aid: np.ndarray, annots: np.ndarray, limits: Sequence[tuple[float, float]]) -> tuple[np.ndarray, ...]:
    """(number of the limit, pid, aid, IoU): for each pair of limits (IoU, confidence), predictions in order of pid take the free annotation of greatest IoU, then least aid.

    Up to 62 limits are walked at once: each bit of an annotation's mask tells that a limit has taken it.
    """
    names, number = np.unique(aid, return_inverse=True)
    order = np.argsort(pid, kind="stable")
    rows, ids, sure = preds[order], pid[order].tolist(), conf[order].tolist()
    heads = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
    out = []
    for first in range(0, len(limits), 62):
        part = limits[first : first + 62]
        floor, steps = min(v for v, _ in part), np.unique([v for v, _ in part])
        passed = np.array([0, *(sum(1 << k for k, (v, _) in enumerate(part) if v <= s) for s in steps)], np.int64)
        bounds = np.unique([c for _, c in part])
        masks = [0, *(sum(1 << n for n, (_, c) in enumerate(part) if c <= b) for b in bounds)]
        taken, left, own, near = np.zeros(len(names), np.int64), annots, number, NearBoxes(annots)
        found: list[tuple[int, int, int, float]] = []
        for walked, (i, end) in enumerate(zip(heads, [*heads[1:], len(ids)], strict=True)):
            options = []
            for k in range(i, end):
                allowed = masks[int(np.searchsorted(bounds, sure[k], "right"))]
                if allowed:
                    at, value = near.ious(rows[k], floor)
                    at = own[at]
                    free = passed[np.searchsorted(steps, value, "right")] & allowed & ~taken[at]
                    live = np.flatnonzero(free)
                    options.append((at[live], value[live], free[live]))
            if options:
                at, value, free = options[0] if len(options) == 1 else (np.concatenate(c) for c in zip(*options, strict=True))
                by = np.lexsort((at, -value))
                seen = np.bitwise_or.accumulate(free[by])
                new = seen & ~np.append(0, seen[:-1]) if len(by) else seen
                for k in np.flatnonzero(new):
                    q = at[by[k]]
                    taken[q] |= new[k]
                    found.append((int(new[k]), ids[i], int(q), float(value[by[k]])))
            if walked % 1024 == 1023:  # annotations that every limit has taken go
                open_ = taken[own] != passed[-1]
                if open_.mean() < 0.8:
                    left, own = left[open_], own[open_]
                    near = NearBoxes(left)
                if not len(own):
                    break
        bits, p, q, v = (np.array(c, t) for c, t in zip(list(zip(*found, strict=True)) or [()] * 4, (np.int64, np.int64, np.int64, np.float64), strict=True))
        for n in range(len(part)):
            mine = np.flatnonzero(bits >> n & 1)
            out.append((np.full(len(mine), first + n), p[mine], names[q[mine]], v[mine]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def suppressed(key: np.ndarray, boxes: np.ndarray, conf: np.ndarray, limit: np.ndarray, difference: float | None) -> np.ndarray:
    """Keys that a fold in key order removes: a row that isn't removed yet keeps the most confident (then first) of itself and its partners, removed ones included.

    Only rows that are still there look for partners. Rows of one key are one row of the fold.
    """
    near = NearBoxes(boxes)
    size = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    names, number = np.unique(key, return_inverse=True)
    trust = np.full(len(names), -np.inf)
    np.maximum.at(trust, number, np.where(np.isnan(conf), -np.inf, conf))
    order = np.argsort(number, kind="stable")
    edge = np.searchsorted(number[order], np.arange(len(names) + 1))
    gone = np.zeros(len(names), bool)
    limits, sizes = limit.tolist(), size.tolist()
    for own in range(len(names)):
        if gone[own]:
            continue
        groups = [np.array([own])]
        for i in order[edge[own] : edge[own + 1]].tolist():
            at, value = near.ious(boxes[i], max(limits[i], 0.0))
            keep = (value > limits[i]) & (number[at] != own)
            if difference is not None:
                at = at[keep]
                most = np.maximum(sizes[i], size[at])
                keep = np.abs(sizes[i] - size[at]) / np.where(most > 0, most, 1.0) < difference
            groups.append(number[at[keep]])
        group = np.concatenate(groups)
        best = group[np.lexsort((group, -trust[group]))[0]]
        gone[group[group != best]] = True
    return names[gone]
