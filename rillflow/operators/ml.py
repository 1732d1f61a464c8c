"""Importance of predictors in a random forest.

The forest grows on the cells of boosting (rows whose bins are all equal): a row's draws are summed up by cell once for some
trees, and then a level of all of them is one pass.  Sums by node and bin are shuffled by tree and nodes, split where they
meet, and only the splits reach the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from . import boosting

CHUNK = 64  # nodes that are shuffled together
HELD = 1 << 27  # bytes of a block's draws; with more, fewer trees grow side by side


def _draws(block: tuple[np.ndarray, ...], trees: Sequence[int], mean: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, and for each tree and cell the number of draws with replacement and the sum of their differences from the mean.

    A row is drawn as often as a Poisson variable of mean 1 says, by its key; equal keys of a cell are told apart by their rank."""
    bins, first, cell, _, y, key = block
    n, at = bins.shape[1], np.arange(len(y))
    same = np.concatenate(([False], (key[1:] == key[:-1])))
    same[first] = False
    key = key + (at - np.maximum.accumulate(np.where(same, 0, at))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    upto = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(17)])
    drawn, sums = np.zeros((len(trees), n), np.uint32), np.zeros((len(trees), n), np.float32)
    for k, t in enumerate(trees):
        u = boosting._uniform(key, seed * 1_000_003 + t)
        times = np.zeros(len(y))
        for bound in upto:
            more = u >= bound
            if not more.any():
                break
            times += more
        drawn[k], sums[k] = (np.bincount(cell, np.add.reduceat(v, first), n) for v in (times, times * (y - mean)))
    return bins, drawn if drawn.max() > 255 else drawn.astype(np.uint8), sums


def _node_sums(held: tuple[np.ndarray, ...], grown: list[boosting.Grown], rank: list[np.ndarray], level: int, offsets: np.ndarray) -> Iterator:
    """((tree, chunk of its open nodes), (places in the chunk, their sums by bin))."""
    bins, drawn, sums = held
    for k, tree in enumerate(grown):
        if rank[k].max() < 0:
            continue
        at = rank[k][boosting._places(tree, bins, level)]
        some = np.flatnonzero((at >= 0) & (drawn[k] > 0))
        at, h, g = at[some].astype(np.intp), drawn[k][some].astype(float), sums[k][some].astype(float)
        n = int(rank[k].max()) + 1
        out = np.zeros((n, int(offsets[-1]), 2))
        for f in range(len(bins)):
            a, b = int(offsets[f]), int(offsets[f + 1])
            cell = at * (b - a) + bins[f][some]
            for j, weight in enumerate((g, h)):
                out[:, a:b, j] = np.bincount(cell, weights=weight, minlength=n * (b - a)).reshape(n, b - a)
        full = out[:, : int(offsets[1]), 1].any(axis=1)
        for c in range(0, n, CHUNK):
            mine = np.flatnonzero(full[c : c + CHUNK])
            if len(mine):
                yield (k, c // CHUNK), (mine.astype(np.uint8), out[c + mine])


def _node_splits(parts: Iterator, offsets: np.ndarray, o: boosting.Options) -> Iterator:
    """((tree, chunk), best splits of its nodes) of the sums that meet in a task."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for key, (mine, sums) in parts:
        if key not in total:
            total[key] = np.zeros((CHUNK, int(offsets[-1]), 2))
        total[key][mine] += sums
    for key, sums in total.items():
        yield key, boosting.best_splits(sums, offsets, range(len(offsets) - 1), o)


def forest_importance(df: DataFrame, names: Sequence[str], target: str, trees: int = 150, depth: int = 12, least: int = 1, seed: int = 42, key: Sequence[str] = (), bins: int = 32) -> list[tuple[str, float]]:
    """Share of each predictor in the fall of squared error, mean of the trees' shares; all predictors are tried at every
    node.  `key` names a row (all columns, if not given); draws depend on it and the seed alone."""
    data = boosting.binned(df, names, target, key or [c for c, kind in df.dtypes if "map<" not in kind], bins=bins)
    gain = np.zeros((trees, len(names)))
    if data.rows is not None:
        n, y, cells = data.rows.map(lambda b: np.array([len(b[4]), b[4].sum(), b[0].shape[1]])).reduce(lambda a, b: np.array([a[0] + b[0], a[1] + b[1], max(a[2], b[2])]))
        side = max(1, min(trees, int(HELD // (5 * cells))))
        for start in range(0, trees, side):
            some = range(start, min(trees, start + side))
            gain[some.start : some.stop] = _grow(data, some, y / n, depth, least, seed)
        data.release()
    share = gain / np.maximum(gain.sum(axis=1, keepdims=True), 1e-300)
    return list(zip(names, (share.sum(axis=0) / max(share.sum(), 1e-300)).tolist(), strict=True))


def _grow(data: boosting.Binned, trees: range, mean: float, depth: int, least: int, seed: int) -> np.ndarray:
    """Gain by tree and predictor of trees that grow side by side."""
    context, o = data.rows.context, boosting.Options(least=float(least), l1=0.0, l2=0.0)
    offsets = np.concatenate(([0], np.cumsum([len(e) + 1 for e in data.edges])))
    held = data.rows.map(lambda b: _draws(b, trees, mean, seed)).persist(StorageLevel.MEMORY_AND_DISK)
    gain, size = np.zeros((len(trees), len(data.names))), 2**depth - 1
    grown = [{"feature": np.full(size, -1), "bin": np.zeros(size, np.int64)} for _ in trees]
    nodes = [np.zeros(1, np.int64) for _ in trees]  # open nodes: their places in the level
    for level in range(depth):
        if not any(map(len, nodes)):
            break
        rank = [np.full(2**level, -1, np.int32) for _ in trees]
        for r, own in zip(rank, nodes, strict=True):
            r[own] = np.arange(len(own))
        sent = context.broadcast((grown, rank))
        parts = held.flatMap(lambda b, lv=level, s=sent: _node_sums(b, *s.value, lv, offsets))
        found = parts.partitionBy(held.getNumPartitions()).mapPartitions(lambda p: _node_splits(p, offsets, o)).collect()
        follow = [[] for _ in trees]
        for (k, c), (feature, at, won, left, total) in found:
            right = total - left
            scale = (left[:, 0] ** 2 / np.maximum(left[:, 1], 1) + right[:, 0] ** 2 / np.maximum(right[:, 1], 1)) / 2
            took = np.flatnonzero((feature >= 0) & (won > 1e-12 * scale))  # less is rounding
            own = nodes[k][c * CHUNK + took]
            grown[k]["feature"][2**level - 1 + own], grown[k]["bin"][2**level - 1 + own] = feature[took], at[took]
            np.add.at(gain[k], feature[took], won[took])
            follow[k] += [2 * own[left[took, 1] >= 2 * least], 2 * own[right[took, 1] >= 2 * least] + 1]
        sent.destroy()
        nodes = [np.sort(np.concatenate(f)) if f else np.zeros(0, np.int64) for f in follow]
    held.unpersist()
    return gain


def grouped_importance(importance: Sequence[tuple[str, float]], groups: dict[str, list[str]]) -> list[tuple[str, float]]:
    """(group, sum of its members' importance), largest first."""
    held = dict(importance)
    return sorted(((g, sum(held.get(c, 0.0) for c in cols)) for g, cols in groups.items()), key=lambda x: -x[1])
