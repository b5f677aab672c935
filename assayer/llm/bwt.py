"""Burrows-Wheeler transforms of shards, merged by iterative interleave refinement.

A shard is a collection of symbol sequences. Its transform comes from its own suffix order; the merge never sorts the
suffixes of all shards together: it keeps only the interleave (which shard the next suffix comes from) and refines it
one symbol a round, by taking the transforms' symbols in interleave order and dealing them out stably. The round in
which two neighbours part gives their common prefix, so repeated intervals fall out of the merge.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the ends of sequences are distinct small symbols, so no two suffixes are equal."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    step = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        key = rank.astype(np.int64) * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank, step = new, 2 * step
        if rank[order[-1]] == n - 1 or step >= n:
            return order


def shard_transform(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, transform) of one shard. symbols: all sequences, each followed by an end, coded 0, at ``ends``."""
    text = symbols.astype(np.int64) + len(ends)
    text[ends] = np.arange(len(ends))
    order = suffix_order(text)
    return order, np.where(order > 0, symbols[order - 1], 0)


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, common prefix with the row before, in symbols, ``depth`` at most).

    The first rows are the ends, one a sequence, in shard order; they match nothing.
    """
    joined = np.concatenate(transforms)
    kind = np.uint16 if not len(joined) or joined.max() < 1 << 16 else np.int64
    joined = joined.astype(kind)
    n = len(joined)
    interleave = np.repeat(np.arange(len(transforms), dtype=np.uint16), [len(t) for t in transforms])
    n_ends = int((joined == 0).sum())
    common = np.full(n, depth, np.int32)
    starts = np.zeros(n, bool)
    starts[:1] = True
    for h in range(1, depth + 1):
        symbols = np.empty(n, kind)
        symbols[np.argsort(interleave, kind="stable")] = joined
        dealt = np.argsort(symbols, kind="stable")
        block = np.cumsum(starts)[dealt]
        now = symbols[dealt]
        new = np.empty(n, bool)
        new[:1] = True
        new[1:] = (now[1:] != now[:-1]) | (block[1:] != block[:-1])
        new[: n_ends + 1] = True
        interleave = interleave[dealt]
        interleave[:n_ends] = np.sort(interleave[:n_ends])
        fresh = new & ~starts if h > 1 else new
        common[fresh & (common == depth)] = h - 1
        if h > 1 and not fresh.any():
            break
        starts = new | starts
    return interleave, common


def ranked(shards: list[tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(for every position of every shard its suffix's row in the merge, the common prefix of every row with the row before)."""
    orders, transforms = zip(*(shard_transform(s, e) for s, e in shards), strict=True)
    interleave, common = merge(list(transforms), depth)
    ranks = []
    for s, order in enumerate(orders):
        of = np.empty(len(order), np.int64)
        of[order] = np.flatnonzero(interleave == s)
        ranks.append(of)
    return ranks, common


def intervals(common: np.ndarray, rows: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, number of rows) of the interval around each of ``rows`` whose suffixes share its first ``shared`` symbols (1 at least)."""
    first, many = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for k in np.unique(shared):
        edges = np.append(np.flatnonzero(common < k), len(common))
        own = shared == k
        at = np.searchsorted(edges, rows[own], side="right") - 1
        first[own], many[own] = edges[at], edges[at + 1] - edges[at]
    return first, many
