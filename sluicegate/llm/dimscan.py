"""Approximate nearest neighbours by an adaptive scan of dimensions.

Unit vectors are rotated by a random orthogonal matrix and scanned in blocks of
columns within probed lists.  After each block a hypothesis test compares the
partial squared distance, scaled to all dimensions, with the query's bound: a
candidate that exceeds it by more than chance explains is abandoned.  Survivors
are scored exactly on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.llm import vectors

#: Columns of a block, and the test's width in standard errors.
BLOCK, EPSILON = 16, 2.1
#: Most lists.
LISTS = 512
_SEED = 41


def probe_share(n: int) -> float:
    """Share of the lists that a query probes: less of larger tables, whose nearest are nearer.

    Fitted on vectors without clusters, the hardest kind; the README has the recall.
    """
    return float(np.clip(0.95 - 0.07 * np.log10(max(n, 1)), 0.2, 0.8))


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(_SEED)).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)
    x = x / top
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centroids(x: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Unit vectors from spherical k-means of a sample of unit vectors."""
    rng = np.random.Generator(np.random.PCG64(_SEED))
    c = x[rng.permutation(len(x))[:count]]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return c


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of paired rows; equal rows give equal results wherever they stand."""
    return (unit(a) * unit(b)).sum(1)


def survivors(q: np.ndarray, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) pairs of rotated unit vectors that no test abandons.

    bound: largest squared distance of interest of each query.
    """
    d = q.shape[1]
    rows = cols = None
    for lo in range(0, d, BLOCK):
        hi = min(lo + BLOCK, d)
        a, b = q[:, lo:hi], x[:, lo:hi]
        if rows is None or len(rows) > 0.2 * len(q) * len(x):
            part = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
            whole = part if rows is None else whole + part  # noqa: F821
            partial = whole.ravel() if rows is None else whole[rows, cols]
        else:
            step = np.empty(len(rows))
            for k in range(0, len(rows), 1 << 18):
                diff = a[rows[k : k + (1 << 18)]] - b[cols[k : k + (1 << 18)]]
                step[k : k + (1 << 18)] = (diff * diff).sum(1)
            partial = partial + step  # noqa: F821
            whole = None
        if rows is None:
            rows, cols = (i.ravel() for i in np.indices((len(q), len(x))))
        width = (1 + EPSILON / np.sqrt(hi)) ** 2 if hi < d else 1.0
        keep = partial * (d / hi) <= bound[rows] * width + 1e-9
        rows, cols, partial = rows[keep], cols[keep], partial[keep]
        if not len(rows):
            break
    return rows, cols


def nearest(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", share: float | None = None) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` (cosine) of the k nearest found.

    Queries: rows whose id is divisible by ``every``; candidates: all rows of
    another id.  Ties go to the smaller id; rows repeated whole are one query
    and as many candidates.  Zero vectors and those that ``vectors.valid_rows``
    leaves out take no part.  Every row is indexed; lists are probed until they
    hold more than k rows, and a share of them at least (``probe_share``).
    """
    rows = vectors.valid_rows(df, id_col, vec_col).where(F.exists("v", lambda x: x != 0))
    n, n_queries, _ = vectors.stats(rows, every)
    if not n_queries:
        return vectors.empty(df.sparkSession, "double")
    sid, sx = vectors.sample(rows, n)
    su = unit(sx)
    centre = centroids(su, min(LISTS, max(4, int(2 * np.sqrt(n))), max(1, len(su) // 4)))
    s_list = (su @ centre.T).argmax(1)
    turn = rotation(sx.shape[1])

    def near(x):
        s = unit(x) @ centre.T
        at = s.argmax(1)
        return at, 1 - s[np.arange(len(x)), at]

    assigned = vectors.deal(rows, near)
    lists = vectors.Lists.of(assigned, centre, n, every, share_units=True)
    wanted = int(np.ceil((probe_share(n) if share is None else share) * len(centre)))

    def route(batches):
        for b in batches:
            if not b.num_rows:
                continue
            qid, q = b.column(0).to_numpy(), vectors.matrix(b.column(1))
            u = unit(q)
            order = np.argsort(-(u @ centre.T), axis=1, kind="stable")
            held = np.cumsum(lists.counts[order], 1)
            enough = (held < k + 8).sum(1) + 1  # k others besides the query's own rows, as a rule
            s = u @ su.T
            floor, places = [], []
            for i in range(len(q)):
                probed = order[i, : max(wanted, enough[i])]
                seen = s[i][np.isin(s_list, probed) & (sid != qid[i])]
                floor.append(np.sort(seen)[-k] - 1e-9 if len(seen) >= k else -2.0)
                places.append(lists.units_of(probed))
            yield vectors.sent(vectors.query_key(qid, q), b, pa.array(floor, pa.float64()), places)

    def scan(held: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if held.num_rows and queries.num_rows:
            x, ids, at = vectors.matrix(held.column("v")), held.column("id").to_numpy(), held.column("list").to_numpy()
            order = np.lexsort((ids, at))
            x, ids, at = x[order], ids[order], at[order]
            xr = unit(x) @ turn
            for lo in range(0, queries.num_rows, 128):
                part = queries.slice(lo, 128)
                q, qid, qkey = vectors.matrix(part.column("qv")), part.column("qid").to_numpy(), part.column("qkey").to_numpy()
                qr, limit, probed = unit(q) @ turn, 2 - 2 * part.column("floor").to_numpy(), part.column("lists").to_pylist()
                rows, cols = [], []
                for mine in np.unique(at).tolist():  # each list with the queries that probe it
                    begin, end = np.searchsorted(at, [mine, mine + 1])
                    asking = np.array([i for i, own in enumerate(probed) if mine in own], np.int64)
                    if len(asking):
                        r, c = survivors(qr[asking], xr[begin:end], limit[asking])
                        rows.append(asking[r])
                        cols.append(c + begin)
                if not rows:
                    continue
                r, c = np.concatenate(rows), np.concatenate(cols)
                ok = qid[r] != ids[c]
                r, c = r[ok], c[ok]
                score = cosine(q[r], x[c])
                order = np.lexsort((ids[c], -score, r))
                r, c, score = r[order], c[order], score[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                ok = place < k
                for col, v in zip(out, (qkey[r[ok]], qid[r[ok]], ids[c[ok]], score[ok]), strict=True):
                    col.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, kinds, strict=True)], names=["qkey", "qid", "id", "score"])

    return vectors.search(assigned, lists, every, route, scan, "double", k)
