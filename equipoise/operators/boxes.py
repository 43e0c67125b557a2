"""Boxes of a point set in few dimensions, for exact neighbour searches of large tables.

A sample of the base is cut at medians until each part stands for a bounded number of rows; these parts are the boxes that
rows and queries are grouped by.  Inside a group a tree of small boxes, cut down to :data:`ENDS` rows, says which rows a
query meets.  A box that lies farther from a query than its k-th distance holds nothing for it.

Distances to boxes and to rows are sums of the same terms in the same order.  Rounding keeps their order, so a box is never
farther by these numbers than any of its rows, and no margin is needed at any offset of the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equipoise.operators.regions import matrix, slabs

MOST_FEATURES = 16  # beyond, boxes exclude next to nothing
MOST_NEAREST = 128  # neighbours of a query; small boxes hold twice as many rows
MOST_BOXES = 16_384
ROWS, LEAST_ROWS = 65_536, 16_384  # base rows of a box, on average
DRAWN = 32  # rows drawn for each box
ENDS = 32  # rows of a small box
_PAIRS = 1_000_000  # pairs of a query and a box held at once
_SLAB = 65_536  # distances held at once, about a core's cache


@dataclass(frozen=True)
class Tree:
    """Boxes within boxes, node 0 around all; a node without ``left`` (-1) is an end.

    Rows of ``left`` have at most ``cut`` in dimension ``dim``.  ``lo`` and ``hi`` are the boxes, a line per dimension.
    """

    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def end(self, v: np.ndarray) -> np.ndarray:
        """The end that each row belongs to."""
        ends, row, node = np.zeros(len(v), np.int64), np.arange(len(v)), np.zeros(len(v), np.int64)
        flat, links = np.ascontiguousarray(v).ravel(), np.column_stack([self.left, self.right]).ravel()
        while len(row):
            left = links[2 * node]
            end = left < 0
            if end.any():
                ends[row[end]] = node[end]
                row, node = row[~end], node[~end]
            node = links[2 * node + (flat[row * v.shape[1] + self.dim[node]] > self.cut[node])]
        return ends

    def met(self, v: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, end): the ends whose box is at most ``bound`` away from the row."""
        columns = np.ascontiguousarray(v.T)
        row, node, found = np.arange(len(v)), np.zeros(len(v), np.int64), []
        while len(row):
            if len(row) > _PAIRS and len(v) > 1:  # boxes exclude little: the rows are taken in two halves
                half = len(v) // 2
                first, second = self.met(v[:half], bound[:half]), self.met(v[half:], bound[half:])
                return np.concatenate([first[0], second[0] + half]), np.concatenate([first[1], second[1]])
            square = np.zeros(len(row))
            for x, lo, hi in zip(columns, self.lo, self.hi, strict=True):
                x = x[row]
                gap = np.maximum(np.maximum(lo[node] - x, x - hi[node]), 0.0)
                square += gap * gap
            near = np.flatnonzero(np.sqrt(square) <= bound[row])
            row, node = row[near], node[near]
            left = self.left[node]
            end = left < 0
            found.append((row[end], node[end]))
            row, left, node = row[~end], left[~end], node[~end]
            row, node = np.concatenate([row, row]), np.concatenate([left, self.right[node]])
        return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (row, node)


def _halves(values: np.ndarray) -> tuple[float, int]:
    """(cut, rows of the smaller side) where at most ``cut`` and above it are nearest to halves."""
    ordered = np.sort(values)
    middle = ordered[(len(ordered) - 1) // 2]
    upto, under = np.searchsorted(ordered, middle, "right"), np.searchsorted(ordered, middle, "left")
    best = min(upto, len(ordered) - upto), float(middle)
    if under:
        best = max(best, (min(under, len(ordered) - under), float(ordered[under - 1])))
    return best[1], int(best[0])


def cut_sample(sample: np.ndarray, rows: int) -> Tree:
    """A tree over the drawn rows whose ends hold at most ``rows`` of them, or one point."""
    dim, cut, left, right, waiting = [0], [math.inf], [-1], [-1], [(0, np.arange(len(sample)))]
    while waiting:
        node, part = waiting.pop()
        if len(part) <= rows:
            continue
        v = sample[part]
        width = v.max(0) - v.min(0)
        if not width.max() > 0:
            continue
        # the widest dimension that halves well, else the one that halves best
        halves = [(*_halves(v[:, j]), j) for j in np.argsort(-width, kind="stable") if width[j] > 0]
        value, _, j = next((h for h in halves if h[1] >= len(part) // 4), max(halves, key=lambda h: h[1]))
        under = v[:, j] <= value
        dim[node], cut[node], left[node], right[node] = int(j), value, len(dim), len(dim) + 1
        waiting += [(left[node], part[under]), (right[node], part[~under])]
        dim += [0, 0]
        cut += [math.inf, math.inf]
        left += [-1, -1]
        right += [-1, -1]
    none = np.zeros((sample.shape[1], len(dim)))
    return Tree(np.array(dim), np.array(cut), np.array(left), np.array(right), none + math.inf, none - math.inf)


def bounded(tree: Tree, boxes: dict[int, tuple[list[float], list[float]]]) -> Tree:
    """With the (least, largest) values of the rows of each end, and around them those of all nodes."""
    lo, hi = tree.lo.copy(), tree.hi.copy()
    for end, (least, most) in boxes.items():
        lo[:, end], hi[:, end] = least, most
    for node in range(len(tree.dim) - 1, -1, -1):  # parts come after what they are part of
        if tree.left[node] >= 0:
            parts = [tree.left[node], tree.right[node]]
            lo[:, node], hi[:, node] = lo[:, parts].min(1), hi[:, parts].max(1)
    return replace(tree, lo=lo, hi=hi)


def boxed(df: DataFrame, tree: Tree) -> DataFrame:
    """The rows whose ``_v`` is finite, with ``_box``, the end of the tree that it belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("_v").is_valid())
            finite = np.isfinite(matrix(batch, "_v")).all(1)  # a null among the features is read as NaN
            if not finite.all():
                batch = batch.filter(pa.array(finite))
            end = tree.end(matrix(batch, "_v")) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(end.astype(np.int32))], [*batch.schema.names, "_box"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("_box", T.IntegerType())]))


def box_sizes(placed: DataFrame, dim: int) -> tuple[dict[int, int], dict[int, tuple[list[float], list[float]]]]:
    """(rows, (least, largest) values) of each box: at most :data:`MOST_BOXES` lines reach the driver."""
    values = [F.get("_v", F.lit(j)) for j in range(dim)]
    sizes = placed.groupBy("_box").agg(F.count("*").alias("n"), F.array(*map(F.min, values)).alias("least"), F.array(*map(F.max, values)).alias("most")).collect()
    return {r["_box"]: r["n"] for r in sizes}, {r["_box"]: (r["least"], r["most"]) for r in sizes}


def few_copies(v: np.ndarray, keep: int) -> np.ndarray:
    """The rows that are among the first ``keep`` copies of their vector, in order."""
    order = np.lexsort(v.T)
    ordered = v[order]
    start = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(1)])
    first = np.flatnonzero(start)
    place = np.arange(len(v)) - first[np.cumsum(start) - 1]
    return np.sort(order[place < keep])


def reached(base: np.ndarray, v: np.ndarray, bound: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether a base row lies in the box around what the queries of some group reach; allows for rounding."""
    far = bound * (1 + 1e-9)
    slack = far[:, None] + 1e-15 * (np.abs(v) + far[:, None])
    low, high, inside = v - slack, v + slack, np.zeros(len(base), bool)
    for g in np.unique(group):
        lo, hi = low[group == g].min(0), high[group == g].max(0)
        here = np.ones(len(base), bool)
        for x, least, most in zip(base.T, lo, hi, strict=True):
            here &= (x >= least) & (x <= most)
        inside |= here
    return inside


class Points:
    """Base rows in small boxes, cut at values so that equal ones stay together."""

    def __init__(self, base: np.ndarray, keep: int) -> None:
        self.count, dim = base.shape
        most = max(ENDS, 2 * keep)
        links, lows, highs, ends = [], [], [], []  # per level: (dim, cut, left, right), boxes; (node, rows) of ends
        rows, sizes, made = np.arange(self.count), np.array([self.count]), 0
        while len(sizes):
            start, nodes = np.cumsum(sizes) - sizes, made + np.arange(len(sizes))
            v = base[rows]
            low, high = np.minimum.reduceat(v, start), np.maximum.reduceat(v, start)
            lows.append(low)
            highs.append(high)
            at = (high - low).argmax(1)
            inner = (sizes > most) & (high - low).max(1).astype(bool)
            segment = np.repeat(np.arange(len(sizes)), sizes)
            value = v[np.arange(len(v)), at[segment]]
            order = np.lexsort((value, segment))
            rows, value = rows[order], value[order]
            middle = value[start + (sizes - 1) // 2]
            upto = np.add.reduceat(value <= middle[segment], start, dtype=np.int64)
            under = np.add.reduceat(value < middle[segment], start, dtype=np.int64)
            first = np.where(np.minimum(upto, sizes - upto) >= np.minimum(under, sizes - under), upto, under)
            made += len(sizes)
            left = np.where(inner, made + 2 * (np.cumsum(inner) - 1), -1)
            links.append((at, value[start + np.maximum(first, 1) - 1], left, np.where(inner, left + 1, -1)))
            ends += [(nodes[i], rows[start[i] : start[i] + sizes[i]]) for i in np.flatnonzero(~inner)]
            rows = rows[inner[segment]]
            sizes = np.column_stack([first, sizes - first])[inner].ravel()
        self.tree = Tree(*map(np.concatenate, zip(*links, strict=True)), *(np.ascontiguousarray(np.concatenate(x).T) for x in (lows, highs)))
        self.place = np.zeros(made, np.int64)  # of an end among the ends
        self.place[[node for node, _ in ends]] = np.arange(len(ends))
        self.rows = np.full((len(ends), max(len(part) for _, part in ends)), self.count)  # filled up with a row at infinity
        for i, (_, part) in enumerate(ends):
            self.rows[i, : len(part)] = part
        points = np.vstack([base, np.full((1, dim), math.inf)])
        self.columns = [np.ascontiguousarray(points[:, j])[self.rows] for j in range(dim)]

    def distances(self, v: np.ndarray, end: np.ndarray) -> np.ndarray:
        """From each row to those of a small box, summed feature by feature."""
        square = np.zeros((len(v), self.rows.shape[1]))
        for j, column in enumerate(self.columns):
            gap = v[:, j, None] - column[end]
            gap *= gap
            square += gap
        return np.sqrt(square, out=square)

    def nearest(self, v: np.ndarray, keep: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, base row, distance) of the ``keep`` nearest at most ``bound`` away, ties by base row; (rows met) by each."""
        width = self.rows.shape[1]
        met, parts = np.zeros(len(v), np.int64), []
        home = self.tree.end(v)
        by_end = np.argsort(home, kind="stable")  # neighbouring queries share what is in the cache
        for s in slabs(len(v), width, _SLAB):
            at = by_end[s]
            qi, bi, distance, met[at] = self._nearest(v[at], home[at], keep, bound[at])
            parts.append((at[qi], bi, distance))
        qi, bi, distance = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.argsort(qi, kind="stable")
        return qi[order], bi[order], distance[order], met

    def _nearest(self, v: np.ndarray, home: np.ndarray, keep: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        width = self.rows.shape[1]
        distance = self.distances(v, self.place[home])
        if width >= keep:
            bound = np.minimum(bound, np.partition(distance, keep - 1, axis=1)[:, keep - 1])
        qi, place = np.nonzero(distance <= bound[:, None])
        found = [(qi, self.rows[self.place[home[qi]], place], distance[qi, place])]
        row, end = self.tree.met(v, bound)
        other = end != home[row]
        row, end = row[other], self.place[end[other]]
        for s in slabs(len(row), width, _SLAB):
            at, there = row[s], end[s]
            distance = self.distances(v[at], there)
            qi, place = np.nonzero(distance <= bound[at][:, None])
            found.append((at[qi], self.rows[there[qi], place], distance[qi, place]))
        qi, bi, distance = (np.concatenate(f) for f in zip(*found, strict=True))
        real = bi < self.count
        qi, bi, distance = qi[real], bi[real], distance[real]
        order = np.lexsort((bi, distance, qi))
        qi, bi, distance = qi[order], bi[order], distance[order]
        best = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") < keep
        return qi[best], bi[best], distance[best], width * (1 + np.bincount(row, minlength=len(v)))
