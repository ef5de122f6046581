"""Exact top-k inner products by dual-tree search over cover trees.

Queries and data are dealt into blocks of bounded size; each pair of blocks is one task, which builds a cover tree on either
side (children lie within half the scale of their parent, and every node knows its measured covering radius) and
descends both together. A node pair is cut when no query of the group can gain from it:
<q,p> + r_q |p| + r_p |q| + r_q r_p, the most that any pair below can score, is less than the group's worst k-th score.
Block results (k per query and block) are ranked once more by query.

Scores are integer inner products of floor(256 x): float arithmetic is used only where every sum is exact.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id. Only
vectors of equal length are compared. Ties go to the smaller vec_id. A row that repeats vec_id and vector counts
once; rows that share a vec_id are never each other's candidates. Scores beyond 64 bits are
reported as the nearest 64-bit number. Fewer than k candidates give fewer rows; an empty
table gives none. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .arrow import runs
from .common import stage

LEAF, CHILDREN = 64, 32
QUERY_BLOCK, DATA_BLOCK = 4096, 8192
LIMIT = (1 << 63) - 1


@dataclass
class CoverTree:
    """Nodes in arrays; `order` lists points so that each node owns order[start:end]."""

    points: np.ndarray
    order: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    end: np.ndarray
    child_at: np.ndarray  # children of node i: child[child_at[i]:child_at[i + 1]]
    child: np.ndarray


def build(points: np.ndarray) -> CoverTree:
    order: list[np.ndarray] = []
    center, radius, start, end, children = [], [], [], [], []
    stack = [(-1, np.arange(len(points)), 0)]
    filled = 0
    while stack:
        parent, own, c = stack.pop()
        me = len(center)
        if parent >= 0:
            children[parent].append(me)
        away = np.sqrt(((points[own] - points[c]) ** 2).sum(1))
        r = float(away.max())
        center.append(c), radius.append(r), children.append([]), start.append(filled), end.append(filled + len(own))
        if len(own) <= LEAF or r == 0:
            order.append(own)
            filled += len(own)
            continue
        half = 2.0 ** (math.ceil(math.log2(r)) - 1)
        centers, rows = [c], [away]
        nearest = away.copy()
        while len(centers) < CHILDREN and (far := np.flatnonzero(nearest > half)).size:
            p = own[far[0]]
            rows.append(np.sqrt(((points[own] - points[p]) ** 2).sum(1)))
            centers.append(p)
            nearest = np.minimum(nearest, rows[-1])
        group = np.argmin(np.stack(rows), axis=0)  # beyond CHILDREN centers, far points join the nearest; the radius tells
        # depth first, so that the points of a node stay together in `order`
        stack.extend((me, own[group == i], centers[i]) for i in range(len(centers)) if (group == i).any())
    at = np.concatenate([[0], np.cumsum([len(x) for x in children])])
    flat = np.array([y for x in children for y in x], np.int64)
    return CoverTree(points, np.concatenate(order), np.array(center), np.array(radius), np.array(start), np.array(end), at, flat)


class Best:
    """The k best candidates of each query so far."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.scores = np.full((len(query_ids), k), -np.inf)
        self.ids = np.full((len(query_ids), k), np.iinfo(np.int64).max)

    def offer(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores[i, j] of candidate ids[j] for queries[i]."""
        scores = np.where(ids[None, :] == self.query_ids[queries][:, None], -np.inf, scores)
        if scores.shape[1] > 4 * self.k:  # only what reaches the k-th best of the offer, ties included, can matter
            least = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k]
            useful = (scores >= np.maximum(least, self.scores[queries, -1])[:, None]).any(axis=0)
            scores, ids = scores[:, useful], ids[useful]
        every = np.concatenate([self.scores[queries], scores], axis=1)
        names = np.concatenate([self.ids[queries], np.broadcast_to(ids, scores.shape)], axis=1)
        place = np.lexsort((names, -every), axis=1)[:, : self.k]
        self.scores[queries] = np.take_along_axis(every, place, 1)
        self.ids[queries] = np.take_along_axis(names, place, 1)


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int) -> Best:
    best = Best(query_ids, k)
    if not len(queries) or not len(data):
        return best
    qt, dt = build(queries), build(data)
    q_norm, d_norm = np.sqrt((queries[qt.center] ** 2).sum(1)), np.sqrt((data[dt.center] ** 2).sum(1))
    some = np.unique(dt.center)[: 16 * LEAF]  # node centers are data too: they give the first k-th scores
    best.offer(np.arange(len(queries)), ids[some], queries @ data[some].T)
    seen = np.zeros(len(data), bool)
    seen[some] = True
    worst = lambda: np.array([best.scores[qt.order[a:b], -1].min() for a, b in zip(qt.start, qt.end)])
    limit = worst()
    q, d = np.zeros(1, np.int64), np.zeros(1, np.int64)
    q_kids, d_kids = np.diff(qt.child_at), np.diff(dt.child_at)
    leaf_q, leaf_d, leaf_bound = [], [], []
    while q.size:
        bound = np.einsum("ij,ij->i", queries[qt.center[q]], data[dt.center[d]]) + qt.radius[q] * d_norm[d] + dt.radius[d] * q_norm[q] + qt.radius[q] * dt.radius[d]
        alive = bound * (1 + 1e-9) + 1e-6 >= limit[q]
        q, d, bound = q[alive], d[alive], bound[alive]
        done = (q_kids[q] == 0) & (d_kids[d] == 0)
        leaf_q.append(q[done]), leaf_d.append(d[done]), leaf_bound.append(bound[done])
        q, d = q[~done], d[~done]
        by_q = (q_kids[q] > 0) & ((d_kids[d] == 0) | (qt.radius[q] >= dt.radius[d]))
        nq, nd = q_kids[q[by_q]], d_kids[d[~by_q]]
        new_q = qt.child[runs(qt.child_at[q[by_q]], nq)]
        new_d = dt.child[runs(dt.child_at[d[~by_q]], nd)]
        q, d = np.concatenate([new_q, np.repeat(q[~by_q], nd)]), np.concatenate([np.repeat(d[by_q], nq), new_d])
    q, d, bound = map(np.concatenate, (leaf_q, leaf_d, leaf_bound))
    place = np.lexsort((-bound, q))
    q, d, bound = q[place], d[place], bound[place]
    cuts = np.flatnonzero(np.diff(q)) + 1
    for a, z in zip([0, *cuts], [*cuts, len(q)]):
        if a == z:
            continue
        own = qt.order[qt.start[q[a]] : qt.end[q[a]]]
        step = 4
        while a < z and bound[a] * (1 + 1e-9) + 1e-6 >= best.scores[own, -1].min():
            members = np.concatenate([dt.order[dt.start[x] : dt.end[x]] for x in d[a : a + min(step, z - a)]])
            members = members[~seen[members]]
            if members.size:
                best.offer(own, ids[members], queries[own] @ data[members].T)
            a, step = a + step, step * 2
    return best


def _exact(rows: list[list[int]], other: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Both sides in a type in which all inner products are exact: doubles up to 2^53, else Python integers."""
    most = lambda x: max((abs(v) for r in x for v in r), default=0)
    exact = most(rows) * most(other) * max(1, len(rows[0])) < 1 << 53
    return (np.array(rows, np.float64), np.array(other, np.float64)) if exact else (np.array(rows, object), np.array(other, object))


RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _distinct(table: pa.Table) -> dict[int, tuple[list[int], list[list[int]]]]:
    """Ids and vectors by length, each (id, vector) once."""
    out: dict[int, tuple[list[int], list[list[int]]]] = {}
    for i, v in sorted({(i, tuple(v)) for i, v in zip(table["vec_id"].to_pylist(), table["v"].to_pylist())}):
        own = out.setdefault(len(v), ([], []))
        own[0].append(i), own[1].append(v)
    return out


def _block(k: int):
    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        left, right = _distinct(queries), _distinct(data)
        rows: list[tuple[int, int, int]] = []
        for n in left.keys() & right.keys():
            (q_ids, q), (ids, d) = left[n], right[n]
            q_ids, ids = np.array(q_ids, np.int64), np.array(ids, np.int64)
            qv, dv = _exact(q, d)
            if qv.dtype == object:  # beyond exact floats: every pair, in integers
                for i in range(len(q)):
                    own = sorted(((-int(np.dot(qv[i], dv[j])), int(ids[j])) for j in range(len(d)) if ids[j] != q_ids[i]))[:k]
                    rows.extend((int(q_ids[i]), j, max(-LIMIT - 1, min(LIMIT, -s))) for s, j in own)
                continue
            best = search(q_ids, qv, ids, dv, k)
            a, b = np.nonzero(np.isfinite(best.scores))
            rows.extend(zip(q_ids[a].tolist(), best.ids[a, b].tolist(), best.scores[a, b].astype(np.int64).tolist()))
        cols = list(zip(*rows)) or [[]] * 3
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=RESULT)

    return run


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id, v = floor(256 x) of the vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    own = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    return own.filter(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))).select("vec_id", F.transform("x", lambda c: F.floor(c * 256).cast("long")).alias("v"))


def top_k(queries: DataFrame, data: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score from tables of vec_id, v."""
    data, queries = stage(data, "topk-data"), stage(queries, "topk-queries")
    n_data, n_queries = max(1, -(-data.count() // DATA_BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(block(n_queries).alias("qb"), every(n_data).alias("db"), "vec_id", "v")
    right = data.select(every(n_queries).alias("qb"), block(n_data).alias("db"), "vec_id", "v")
    found = left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db")).applyInArrow(_block(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
