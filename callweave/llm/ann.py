"""Nearest neighbours by collision counting over sorted projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.common import stage

#: Projections, the share of them a candidate must collide in, the half-window (in distances of the k-th neighbour
#: found) at which the search ends, and the growth of windows from one round to the next.
PROJECTIONS, SHARE, REACH, GROWTH = 96, 0.74, 1.3, 1.4
#: Vectors indexed together, and queries sent to all tasks at once.
INDEX_ROWS, QUERY_ROWS = 32_768, 16_384
SEED = 20


def usable(v: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    d = F.transform(v, lambda x: x.cast("double"))
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(d, lambda x: x != 0), F.lit(False))


def projections(dim: int) -> np.ndarray:
    """Gaussian directions, the same for every block of vectors of one length."""
    return np.random.default_rng([SEED, dim]).standard_normal((PROJECTIONS, dim))


class Index:
    """Sorted arrays of the projections of some vectors of one length; `verified` counts distances computed."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, order: np.ndarray | None = None):
        self.ids, self.x, self.a, self.verified = ids, x, projections(x.shape[1]), 0
        p = x @ self.a.T
        self.order = np.argsort(p, axis=0, kind="stable").T.astype(np.uint16 if len(x) <= 1 << 16 else np.int64) if order is None else order
        line = np.take_along_axis(p, self.order.T.astype(np.int64), 0).T
        self.low, self.high = line[:, 0] - 1, line[:, -1] + 1
        self.gap = (self.high - self.low).max() * np.arange(PROJECTIONS)
        self.flat = (line - self.low[:, None] + self.gap[:, None]).ravel()  # all arrays in one, each in its own stretch
        self.first = max(float(p.std(0).mean()) * 0.2, 1e-12)

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest found, itself left out. Each round widens the window around the query's
        projection by GROWTH (virtual rehashing), counts new collisions, verifies the vectors that reach the threshold,
        and ends once windows reach past REACH times the k-th distance, or over all vectors. No candidate is capped."""
        n = len(self.ids)
        at, half, begin = self.a @ q, self.first, np.arange(PROJECTIONS) * n
        place = lambda v, side: np.searchsorted(self.flat, np.clip(v, self.low, self.high) - self.low + self.gap, side)
        lo = hi = np.clip(place(at, "left"), begin, begin + n)
        count = np.zeros(n, np.int32)
        need = int(np.ceil(SHARE * PROJECTIONS))
        found, dist, seen = np.zeros(0, np.int64), np.zeros(0), np.zeros(n, bool)
        seen[self.ids == own] = True
        order = self.order.ravel()
        while True:
            left, right = np.clip(place(at - half, "left"), begin, lo), np.clip(place(at + half, "right"), hi, begin + n)
            fresh = [order[a:b] for a, b in zip([*left.tolist(), *hi.tolist()], [*lo.tolist(), *right.tolist()], strict=True) if a < b]
            if fresh:
                count += np.bincount(np.concatenate(fresh), minlength=n).astype(np.int32)
            lo, hi = left, right
            new = np.flatnonzero((count >= need) & ~seen)
            if len(new):
                seen[new] = True
                self.verified += len(new)
                found, dist = np.concatenate([found, new]), np.concatenate([dist, np.sqrt(((self.x[new] - q) ** 2).sum(1))])
                if len(found) > k:
                    keep = dist <= np.partition(dist, k - 1)[k - 1]
                    found, dist = found[keep], dist[keep]
            if (len(found) >= k and half >= REACH * dist.max()) or (hi - lo == n).all():
                break
            half = min(half * GROWTH, REACH * dist.max()) if len(found) >= k and REACH * dist.max() > half else half * GROWTH
        best = np.lexsort((self.ids[found], dist))[:k]
        return self.ids[found[best]], dist[best]


BLOCK = "dim int, ids binary, x binary, places binary"


def index_blocks(vectors: DataFrame) -> DataFrame:
    """Staged index: a row for each INDEX_ROWS vectors of one length that a task reads, with their ids, components and,
    for each projection, their places in its order. All vectors (vec_id, embedding as doubles) are in it."""
    kind = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("x", pa.binary()), ("places", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def built(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            ids, v = t["vec_id"].to_numpy(), t["embedding"].combine_chunks()
            sizes, values = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy()
            begin = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                pick = np.flatnonzero(sizes == dim)
                x = values[begin[pick][:, None] + np.arange(dim)]
                index = Index(ids[pick], x)
                yield pa.RecordBatch.from_arrays([pa.array([y], t) for y, t in zip((dim, ids[pick].astype(np.int64).tobytes(), x.tobytes(), index.order.tobytes()), kind.types, strict=True)], schema=kind)

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= INDEX_ROWS:
                yield from built(held)
                held, n = [], 0
        if n:
            yield from built(held)

    return stage(vectors.mapInArrow(run, BLOCK), "index")


def knn(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest of vectors by Euclidean distance, nearest first,
    ties to the smaller vec_id; all, if there are fewer. Both inputs have vec_id and embedding; a query's own id is no
    candidate; vectors that aren't usable, or of another length than the query's, take no part. An id given twice keeps
    its vector that is smallest in array order.

    The index is built and written once. Queries come to its blocks by broadcast, QUERY_ROWS at once, so neither side
    must fit in memory; the k best of each block are merged per query."""
    clean = lambda df: df.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = stage(clean(queries).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding")), "queries")
    rounds = max(1, -(-asked.count() // QUERY_ROWS))
    index = index_blocks(clean(vectors).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding")))
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    sc = queries.sparkSession.sparkContext
    found = None
    for part in range(rounds):
        rows = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == part).toArrow()  # QUERY_ROWS or a few more
        sent = sc.broadcast((rows["vec_id"].to_numpy(), [np.array(v, np.float64) for v in rows["embedding"].to_pylist()]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    n, ids = len(r["ids"]) // 8, np.frombuffer(r["ids"], np.int64)
                    order = np.frombuffer(r["places"], np.uint16 if n <= 1 << 16 else np.int64).reshape(PROJECTIONS, n)
                    index = Index(ids, np.frombuffer(r["x"]).reshape(n, r["dim"]), order)
                    out = [(q, *index.search(q, x, k)) for q, x in zip(sent.value[0].tolist(), sent.value[1], strict=True) if len(x) == r["dim"]]
                    if out:
                        yield pa.RecordBatch.from_arrays([np.repeat([o[0] for o in out], [len(o[1]) for o in out]), np.concatenate([o[1] for o in out]).astype(np.int64), np.concatenate([o[2] for o in out])], schema=kind)

        near = index.mapInArrow(run, "query_id long, vec_id long, score double")
        found = near if found is None else found.unionByName(near)
    near = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
