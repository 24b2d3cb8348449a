"""Navigable small-world graphs over Hamming distance, searched for many queries in step; and connected components over Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, release, work_table

FAR = 1 << 12


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits along the last axis of two uint64 arrays."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


class SmallWorld:
    """Points join in a random order, in growing batches. Each keeps links to its nearest points so far, so that early points keep long links; to the nearest of those
    that chose it later; and to the loneliest of those whose nearest point it is, so that no cluster loses its way in. Searches start from the best of the first points."""

    def __init__(self, points: np.ndarray, links: int = 8, lonely: int = 4, beam: int = 16, starts: int = 256, seed: int = 1):
        n = len(points)
        self.points, self.own, self.starts = points, links, starts
        self.links = np.full((n, 2 * links + lonely), -1, np.int64)
        self.order, self.size = np.random.default_rng(seed).permutation(n), 0
        while self.size < n:
            batch = self.order[self.size : self.size + max(32, min(512, self.size))]
            d_in = hamming(points[batch][:, None], points[batch][None])
            np.fill_diagonal(d_in, FAR)
            near = np.argsort(d_in, 1, kind="stable")[:, :links]
            ids, dist = batch[near], np.take_along_axis(d_in, near, 1)
            if self.size:
                got, gd = self.search(points[batch], min(beam, self.size))
                ids, dist = np.concatenate([got, ids], 1), np.concatenate([gd, dist], 1)
            pick = np.argsort(dist, 1, kind="stable")[:, :links]
            self._connect(batch, np.take_along_axis(ids, pick, 1), np.take_along_axis(dist, pick, 1))
            self.size += len(batch)
        # both ways, for the steps within a radius: a point that many equal ones chose leads to all of them
        row, col = np.nonzero(self.links >= 0)
        to = self.links[row, col]
        code = np.unique(np.concatenate([row * n + to, to * n + row]))
        self.begin, self.ends = np.searchsorted(code, np.arange(n + 1) * n), code % max(n, 1)

    def _connect(self, new: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        k = self.own
        self.links[new, : ids.shape[1]] = np.where(dist < FAR, ids, -1)
        row, col = np.nonzero(dist < FAR)
        self._back(ids[row, col], new[row], dist[row, col], slice(k, 2 * k), 1)
        row = np.flatnonzero(dist[:, 0] < FAR)
        self._back(ids[row, 0], new[row], dist[row, 0], slice(2 * k, None), -1)

    def _back(self, at: np.ndarray, new: np.ndarray, dist: np.ndarray, slots: slice, sign: int) -> None:
        """Offers links from `at` to `new`; the slots keep the nearest, or with a negative sign the farthest."""
        width = self.links[:1, slots].shape[1]
        order = np.lexsort((sign * dist, at))
        at, new, dist = at[order], new[order], dist[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        at, new, dist, rank = (x[rank < width] for x in (at, new, dist, rank))
        nodes, where = np.unique(at, return_inverse=True)
        old = self.links[nodes, slots]
        ids = np.concatenate([old, np.full((len(nodes), width), -1)], 1)
        d = np.full(ids.shape, FAR if sign > 0 else -1)
        d[:, :width] = np.where(old >= 0, hamming(self.points[old], self.points[nodes][:, None]), d[:, :width])
        ids[where, width + rank], d[where, width + rank] = new, dist
        pick = np.argsort(sign * d, 1, kind="stable")[:, :width]
        self.links[nodes, slots] = np.take_along_axis(ids, pick, 1)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the beam's points for each query, nearest first; missing places have id -1."""
        q, none = len(queries), np.int64(FAR) << 34
        start = self.order[: min(self.starts, max(self.size // 8, 32), max(self.size, 1))]
        keys = np.full((q, beam), none)
        first = hamming(queries[:, None], self.points[start][None]) << 34 | start << 1 | 1
        if first.shape[1] > beam:
            first = np.partition(first, beam - 1, 1)[:, :beam]
        first.sort(1)
        keys[:, : first.shape[1]] = first
        live = np.arange(q)
        while len(live):
            k = keys[live]
            open_ = (k & 1 == 1) & (k < none)
            some = open_.any(1)
            live, k, open_ = live[some], k[some], open_[some]
            if not len(live):
                break
            at = open_.argmax(1)
            rows = np.arange(len(live))
            node = k[rows, at] >> 1 & 0xFFFFFFFF
            k[rows, at] -= 1
            nb = self.links[node]
            d = np.where(nb >= 0, hamming(self.points[nb], queries[live][:, None]), FAR)
            new = np.where(nb >= 0, d << 34 | nb << 1 | 1, none)
            k = np.concatenate([k, new], 1)
            k.sort(1)
            again = np.zeros(k.shape, bool)
            again[:, 1:] = (k[:, 1:] >> 1 == k[:, :-1] >> 1) & (k[:, 1:] < none)
            if again.any():
                k[again] = none
                k.sort(1)
            keys[live] = k[:, :beam]
        found = keys < none
        return np.where(found, keys >> 1 & 0xFFFFFFFF, -1), np.where(found, keys >> 34, FAR)

    def within(self, queries: np.ndarray, radius: int, beam: int = 16, block: int = 128):
        """(query, point, distance) of points found within the radius: the beam's, and then, as long as any point within the radius is new, those next to it. So a beam grows to all its hits, and hits cost their links alone."""
        ids, dist = self.search(queries, min(beam, len(self.points)))
        out, n = [], len(self.points)
        place = np.empty(min(block, len(queries)) * n, np.int64)
        for lo in range(0, len(queries), block):
            q = queries[lo : lo + block]
            seen = np.zeros((len(q), n), bool)
            qi, k = np.nonzero(ids[lo : lo + block] >= 0)
            pi, d = ids[lo + qi, k], dist[lo + qi, k]
            seen[qi, pi] = True
            while True:
                hit = d <= radius
                qi, pi, d = qi[hit], pi[hit], d[hit]
                if not len(qi):
                    break
                out.append((qi + lo, pi, d))
                deg = self.begin[pi + 1] - self.begin[pi]
                step = np.arange(int(deg.sum())) - np.repeat(np.cumsum(deg) - deg - self.begin[pi], deg)
                code = np.repeat(qi, deg) * n + self.ends[step]
                code = code[~seen.ravel()[code]]
                at = np.arange(len(code))
                place[code] = at  # of equal ones the last stays
                code = code[place[code] == at]
                qi, pi = code // n, code % n
                seen[qi, pi] = True
                d = hamming(self.points[pi], q[qi])
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int),) * 3


def exact_within(points: np.ndarray, queries: np.ndarray, radius: int, block: int = 256):
    """The same by comparing a block of queries with all points."""
    out = []
    for lo in range(0, len(queries), block):
        part = queries[lo : lo + block]
        d = sum(np.bitwise_count(part[:, None, w] ^ points[None, :, w]).astype(np.int16) for w in range(points.shape[1]))
        q, p = np.nonzero(d <= radius)
        out.append((q + lo, p, d[q, p]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int),) * 3


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """id, component (its least id) of each end of the edges (a, b): large and small stars in turn until nothing changes. Raises where they haven't settled after so many rounds."""
    e = work_table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        old, e = e, work_table(small.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        release(old)
        new = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    ids = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out = ids.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    out.work_path = e.work_path
    return out
