"""Exact top-k inner products by best-first search of M-trees.

Inner products become a metric by one more component: every candidate gets
sqrt(M^2 - |x|^2), queries get 0, and the nearest candidate is the one of the
highest product.  The root's routing objects are pivots from a bounded sample; a
unit of a pivot's rows is a subtree of paged leaf nodes.  A node has a routing
object and a covering radius, an entry its distance to that object.  Queries
visit nodes in order of their lower bounds, stop where the bound exceeds their
k-th best so far, and skip entries whose stored distances already exclude them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sluicegate.llm import vectors

#: Most routing objects of the root; entries of a leaf node, about.
PIVOTS, PAGE = 256, 64
_NONE = -(2**63)


def _aug(x: np.ndarray, top: float) -> np.ndarray:
    return np.sqrt(np.maximum(top - (x * x).sum(1), 0))


def distances(a: np.ndarray, a_extra: np.ndarray, b: np.ndarray, b_extra: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows with their extra components."""
    s = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T) + (a_extra[:, None] - b_extra[None]) ** 2
    return np.sqrt(np.maximum(s, 0))


def far_apart(x: np.ndarray, extra: np.ndarray, count: int) -> np.ndarray:
    """Rows chosen one by one, each the farthest from those before it."""
    chosen = [0]
    gap = distances(x, extra, x[:1], extra[:1])[:, 0]
    while len(chosen) < min(count, len(x)):
        i = int(gap.argmax())
        if gap[i] <= 0:
            break
        chosen.append(i)
        gap = np.minimum(gap, distances(x, extra, x[i : i + 1], extra[i : i + 1])[:, 0])
    return np.array(chosen)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where these are exact, else in 64-bit integers."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 2**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


class Subtree:
    """Leaf nodes over the rows of a unit."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, root_distance: np.ndarray, top: float):
        extra = _aug(x, top)
        routers = far_apart(x, extra, -(-len(x) // PAGE))
        self.router, self.router_extra = x[routers], extra[routers]
        dist = distances(x, extra, self.router, self.router_extra)
        node = dist.argmin(1)
        self.pages = []
        for p in range(len(routers)):
            at = np.flatnonzero(node == p)
            at = at[np.argsort(dist[at, p], kind="stable")]
            self.pages.append((ids[at], x[at], dist[at, p], root_distance[at]))
        self.radius = np.array([pd[-1] if len(pd) else -np.inf for _, _, pd, _ in self.pages])
        self.least = np.array([pd[0] if len(pd) else np.inf for _, _, pd, _ in self.pages])

    def search(self, qid: np.ndarray, q: np.ndarray, to_root: np.ndarray, floor: np.ndarray, k: int, top: float, slack: float):
        """(scores, ids) of the k best at or above ``floor`` (the k-th best known) of each query; missing: _NONE."""
        m = len(q)
        norm = (q * q).sum(1)
        scores, ids = np.full((m, k), _NONE, np.int64), np.full((m, k), 2**63 - 1, np.int64)
        reach = np.where(floor > _NONE, np.sqrt(np.maximum(norm + top - 2 * floor.astype(float), 0)), np.inf) + slack
        to = distances(q, np.zeros(m), self.router, self.router_extra)
        bound = np.maximum(np.maximum(to - self.radius, self.least - to), 0)
        order = np.argsort(bound, axis=1, kind="stable")
        for t in range(order.shape[1]):
            page = order[:, t]
            going = np.flatnonzero(bound[np.arange(m), page] <= reach)
            if not len(going):
                break  # bounds only grow
            for p in np.unique(page[going]):
                qs = going[page[going] == p]
                pid, px, pd, root = self.pages[p]
                near = np.abs(to[qs, p][:, None] - pd) <= reach[qs][:, None]
                near &= np.abs(to_root[qs][:, None] - root) <= reach[qs][:, None]
                cols = np.flatnonzero(near.any(0))
                if not len(cols):
                    continue
                s = products(q[qs], px[cols])
                ok = near[:, cols] & (pid[cols][None] != qid[qs][:, None]) & (s >= floor[qs][:, None])
                s = np.where(ok, s, _NONE)
                i = np.where(ok, pid[cols][None], 2**63 - 1)
                # lowest integers sort last: negate as floats is not exact, so flip bits
                s2, i2 = np.concatenate([scores[qs], s], 1), np.concatenate([ids[qs], i], 1)
                rank = np.lexsort((i2, ~s2), axis=1)[:, :k]
                scores[qs], ids[qs] = np.take_along_axis(s2, rank, 1), np.take_along_axis(i2, rank, 1)
                floor[qs] = np.maximum(floor[qs], scores[qs, k - 1])
                reach[qs] = np.minimum(reach[qs], np.where(floor[qs] > _NONE, np.sqrt(np.maximum(norm[qs] + top - 2 * floor[qs].astype(float), 0)) + slack, np.inf))
        return scores, ids


def top_k(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the k highest inner products of integer vectors.

    Queries: rows whose id is divisible by ``every``; candidates: all rows of
    another id.  Ties go to the smaller id; rows repeated whole are one query
    and as many candidates.  Rows that take part: see ``vectors.valid_rows``;
    components must be whole numbers.  Empty table, or one row: no rows.
    """
    rows = vectors.valid_rows(df, id_col, vec_col)
    n, n_queries, top = vectors.stats(rows, every)
    if not n_queries:
        return vectors.empty(df.sparkSession, "long")
    slack = 1e-6 * (1 + np.sqrt(top))
    sid, sx = vectors.sample(rows, n)
    s_extra = _aug(sx, top)
    chosen = far_apart(sx, s_extra, min(PIVOTS, max(4, int(np.sqrt(n) / 8))))
    pivot, p_extra = sx[chosen], s_extra[chosen]

    def nearest(x):
        d = distances(x, _aug(x, top), pivot, p_extra)
        at = d.argmin(1)
        return at, d[np.arange(len(x)), at]

    assigned = vectors.deal(rows, nearest)
    lists = vectors.Lists.of(assigned, pivot, n, every)

    def route(batches):
        for b in batches:
            if not b.num_rows:
                continue
            qid, q = b.column(0).to_numpy(), vectors.matrix(b.column(1))
            s = products(q, sx)
            s[sid[None] == qid[:, None]] = _NONE
            floor = np.sort(s, 1)[:, -k] if s.shape[1] >= k else np.full(len(q), _NONE)
            reach = np.where(floor > _NONE, np.sqrt(np.maximum((q * q).sum(1) + top - 2 * floor.astype(float), 0)), np.inf) + slack
            to = distances(q, np.zeros(len(q)), pivot, p_extra)
            admitted = np.maximum(to - lists.most, lists.least - to) <= reach[:, None]
            places = [lists.units_of(np.flatnonzero(a)) for a in admitted]
            yield vectors.sent(vectors.query_key(qid, q), b, pa.array(floor, pa.int64()), places)

    def scan(held: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if held.num_rows and queries.num_rows:
            at = held.column("list")[0].as_py()
            tree = Subtree(held.column("id").to_numpy(), vectors.matrix(held.column("v")), held.column("dist").to_numpy(), top)
            q, qid, qkey = vectors.matrix(queries.column("qv")), queries.column("qid").to_numpy(), queries.column("qkey").to_numpy()
            to_root = distances(q, np.zeros(len(q)), pivot[at : at + 1], p_extra[at : at + 1])[:, 0]
            scores, ids = tree.search(qid, q, to_root, queries.column("floor").to_numpy().copy(), k, top, slack)
            r, c = np.nonzero(scores > _NONE)
            out = [qkey[r], qid[r], ids[r, c], scores[r, c]]
        return pa.table(out or [pa.array([], pa.int64())] * 4, names=["qkey", "qid", "id", "score"])

    return vectors.search(assigned, lists, every, route, scan, "long", k)
