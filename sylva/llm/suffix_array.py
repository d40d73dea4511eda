"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai's common prefixes, merging by binary search."""

from __future__ import annotations

import numpy as np

U = np.uint64


def suffix_array(data: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffixes of data (uint8) in the order of their first depth bytes at least (all bytes if None).

    The first order is by eight bytes. Each round doubles the depth by the ranks of the round before, and sorts only
    the groups that are still larger than one suffix, as Larsson and Sadakane do. Suffixes that are equal to the
    depth asked for stay in one group, in order of position. An ended suffix is smaller than a longer one.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    padded = np.zeros(n + 8, U)
    padded[:n] = data.astype(U) + U(1)  # 9 bits a symbol: 0 is the end, so 7 symbols fit in 63 bits
    key = np.zeros(n, U)
    for j in range(7):
        key = (key << U(9)) | padded[j : n + j]
    sa = np.argsort(key, kind="stable")
    group = np.zeros(n, np.int64)
    ordered = key[sa]
    heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    group[sa] = np.repeat(heads, np.diff(np.append(heads, n)))  # rank: where the group begins
    h = 7
    sizes = np.diff(np.append(heads, n))
    at = np.flatnonzero(np.repeat(sizes > 1, sizes))  # slots of the unsorted groups
    while len(at) and (depth is None or h < depth):
        own = sa[at]
        nxt = own + h
        second = np.where(nxt < n, group[np.minimum(nxt, n - 1)] + 1, 0)
        first = group[own]
        order = np.argsort(first * (n + 1) + second, kind="stable") if n < 3_000_000_000 else np.lexsort((second, first))
        own, first, second = own[order], first[order], second[order]
        sa[at] = own
        new = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(at)))
        group[own] = np.repeat(at[starts], sizes)
        at = at[np.repeat(sizes > 1, sizes)]
        h *= 2
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, cap: int, lanes: int = 4096) -> np.ndarray:
    """Kasai's algorithm: bytes that each suffix shares with the one before it in sa, up to cap.

    The text is cut into lanes that walk in step, so that each step is one numpy operation over all lanes; within a
    lane the length falls by at most one from a position to the next, as Kasai shows. The first suffix has 0.
    """
    n = len(data)
    out = np.zeros(n, np.int32)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    stride = -(-n // min(lanes, n))
    lane = np.arange(0, n, stride)
    h = np.zeros(len(lane), np.int64)
    plcp = np.zeros(n, np.int32)
    for step in range(stride):
        here = lane + step
        h = np.maximum(h - 1, 0)
        live = np.flatnonzero(here < n)
        other = before[here[live]]
        h[live[other < 0]] = 0
        live, other = live[other >= 0], other[other >= 0]
        while len(live):
            a, b = here[live] + h[live], other + h[live]
            go = (h[live] < cap) & (a < n) & (b < n)
            go[go] = data[a[go]] == data[b[go]]
            live, other = live[go], other[go]
            h[live] += 1
        within = here < n
        plcp[here[within]] = h[within]
    out[:] = plcp[sa]
    return out


def smallest(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, smallest owner of each)."""
    found, place = np.unique(keys, return_inverse=True)
    least = np.full(len(found), np.iinfo(np.int64).max)
    np.minimum.at(least, place, owners)
    return found, least


def merge_shards(shards: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted list of the distinct keys of several sorted lists, with the smallest owner of each.

    Each list finds its keys in the merged list by binary search.
    """
    keys = np.unique(np.concatenate([k for k, _ in shards])) if shards else np.zeros(0, U)
    least = np.full(len(keys), np.iinfo(np.int64).max)
    for own, owners in shards:
        place = np.searchsorted(keys, own)
        np.minimum.at(least, place, owners)
    return keys, least
