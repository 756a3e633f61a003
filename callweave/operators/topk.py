"""Exact best rows for many queries by words and vectors, without a row for every pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from callweave.operators import search

#: Queries that go to the tasks together, and cells (rows by queries) of one block of scores.
QUERY_ROWS, CELLS = 4096, 1 << 22
#: Scores that agree to so many decimal places tie: the order of a floating sum then doesn't show.
PLACES = 12


def _flat(lists: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each element, elements) of a list column; null lists have none."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)), lists.flatten()


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of length 1 of a column of vectors; zeros where there is none, and for a vector of another width."""
    out = np.zeros((len(lists), width))
    row, flat = _flat(lists)
    size = np.bincount(row, minlength=len(lists))
    fits = np.flatnonzero(size == width)
    if width and len(fits):
        out[fits] = flat.to_numpy(zero_copy_only=False).astype(np.float64)[(size == width)[row]].reshape(-1, width)
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)


class Queries:
    """A block of queries: ids, unit vectors, and the queries that ask for each token with what a match weighs."""

    def __init__(self, rows: pa.Table):
        self.ids = rows.column("query_id").combine_chunks()
        vectors = rows.column("vector").combine_chunks()
        size = pc.max(pc.list_value_length(vectors)).as_py()
        self.vectors = _matrix(vectors, size or 0)
        row, tokens = _flat(rows.column("tokens"))
        weight = _flat(rows.column("weights"))[1].to_numpy(zero_copy_only=False).astype(np.float64)
        coded = tokens.dictionary_encode()
        self.tokens, code = coded.dictionary, coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        self.query, self.weight = row[order], weight[order]  # by token
        self.first = np.searchsorted(code[order], np.arange(len(self.tokens) + 1))
        self.monotone = bool((self.weight >= 0).all())  # no bound holds otherwise


class Best:
    """The k best rows so far of each query of a block."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.held = {"query": np.zeros(0, np.int64), "score": np.zeros(0), "vector": np.zeros(0), "lexical": np.zeros(0), "key": np.zeros(0, object)}
        self.least = np.full(n, -np.inf)  # the k-th best score, where there are k

    def add(self, **more: np.ndarray) -> None:
        rows = {c: np.concatenate([x, more[c]]) for c, x in self.held.items()}
        by_key = np.argsort(rows["key"], kind="stable")
        order = by_key[np.lexsort((-rows["score"][by_key], rows["query"][by_key]))]
        query = rows["query"][order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = order[rank < self.k]
        self.held = {c: x[keep] for c, x in rows.items()}
        full = order[rank == self.k - 1]
        self.least[rows["query"][full]] = rows["score"][full]


def search_block(best: Best, q: Queries, keys: np.ndarray, vectors: np.ndarray, row: np.ndarray, token: np.ndarray, impact: np.ndarray, weights: tuple[float, float], half: float, matched: bool) -> None:
    """Offers a block of rows, in order of key, to `best`. row, token, impact: the block's postings of the queries' tokens.

    Vector scores come first. They, and the largest impact of each token in the block, bound what a query can find here;
    only queries that can still find something have their words counted."""
    n = len(q.ids)
    near = vectors @ q.vectors.T if q.vectors.shape[1] else np.zeros((len(keys), n))
    live = np.arange(n)
    if q.monotone and weights[1] >= 0:
        top = np.zeros(len(q.tokens))
        np.maximum.at(top, token, impact)
        raw = np.bincount(q.query, q.weight * np.repeat(top, np.diff(q.first)), n)
        live = np.flatnonzero(weights[0] * near.max(0) + weights[1] * search.saturate(raw, half) + 1e-9 >= best.least)
        if not len(live):
            return
    place = np.full(n, -1)
    place[live] = np.arange(len(live))
    # each posting meets the queries of its token
    many = np.diff(q.first)[token]
    at = np.repeat(q.first[:-1][token] - np.cumsum(many) + many, many) + np.arange(many.sum())
    to = place[q.query[at]]
    some = to >= 0
    cell = np.repeat(row, many)[some] * len(live) + to[some]
    raw = np.bincount(cell, (np.repeat(impact, many) * q.weight[at])[some], len(keys) * len(live)).reshape(len(keys), -1)
    near = near[:, live]
    lexical = search.saturate(raw, half)
    score = np.round(weights[0] * near + weights[1] * lexical, PLACES)
    if matched:
        hit = np.zeros(len(keys) * len(live), bool)
        hit[cell] = True
        score[~hit.reshape(score.shape)] = -np.inf
    kth = np.partition(score, len(keys) - best.k, axis=0)[len(keys) - best.k] if len(keys) > best.k else np.full(len(live), -np.inf)
    good = (score >= np.maximum(kth, best.least[live])) & (score > -np.inf)
    tied = np.flatnonzero(good.sum(0) > 4 * best.k)  # of many equal scores the smallest keys are enough
    if len(tied):
        first = np.argsort(-score[:, tied], axis=0, kind="stable")[: best.k]
        only = np.zeros((len(keys), len(tied)), bool)
        np.put_along_axis(only, first, True, 0)
        good[:, tied] &= only
    r, c = np.nonzero(good)
    best.add(query=live[c], score=score[r, c], vector=near[r, c], lexical=lexical[r, c], key=keys[r])


def top_k(queries: DataFrame, pool: DataFrame, key: str, k: int = 8, weights: tuple[float, float] = (0.6, 0.4), half: float = 6.0, average: float = 1.0, matched: bool = False) -> DataFrame:
    """query_id, key, vector_score, bm25_score, score, rank: the k best rows of pool for each query, ties to the smaller
    key. queries: query_id, tokens, weights (how often a token is asked times its idf), vector; pool: key, tokens, counts,
    length (words of the row), vector. score is weights[0] * cosine + weights[1] * raw / (raw + half), raw being BM25's
    sum; scores that agree to PLACES decimals tie. A side that a query or a row doesn't have counts 0; with `matched`
    only rows that share a token are found, and rows without a key never are.

    Queries go to the tasks in blocks of QUERY_ROWS; pool is read once a block. A task takes its rows in blocks of CELLS
    scores, keeps the k best rows of each query, skips what can't reach them by upper bounds, and gives out only these;
    they are ranked once more over all tasks. So what is shuffled is k rows a query and task, and a frequent token's
    rows stay where their documents are."""
    kinds = {f.name: f.dataType for f in (*queries.select("query_id").schema, *pool.select(key).schema)}
    schema = S.StructType([S.StructField("query_id", kinds["query_id"]), S.StructField(key, kinds[key]), *[S.StructField(c, S.DoubleType()) for c in ("vector_score", "bm25_score", "score")]])
    rows = pool.filter(F.col(key).isNotNull()).select(key, "tokens", "counts", "length", "vector")
    q = queries.select("query_id", "tokens", "weights", "vector")
    blocks, found = max(1, -(-q.count() // QUERY_ROWS)), None
    for i in range(blocks):
        block = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()
        sent = queries.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked = Queries(sent.value)
            if not len(asked.ids):
                return
            best, step, kinds = Best(len(asked.ids), k), max(1, CELLS // len(asked.ids)), None
            for whole in batches:
                kinds = whole.schema
                for at in range(0, whole.num_rows, step):
                    b = whole.slice(at, step)
                    b = b.take(pc.sort_indices(b.column(key)))
                    row, tokens = _flat(b.column("tokens"))
                    code = pc.index_in(tokens, value_set=asked.tokens) if len(asked.tokens) else pa.nulls(len(tokens), pa.int32())
                    got = np.flatnonzero(pc.is_valid(code).to_numpy(zero_copy_only=False))
                    tf = _flat(b.column("counts"))[1].to_numpy(zero_copy_only=False).astype(np.float64)[got]
                    length = pc.fill_null(b.column("length"), 0).to_numpy(zero_copy_only=False).astype(np.float64)[row[got]]
                    impact = tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * length / average))
                    keys = np.array(b.column(key).to_pylist(), object)
                    search_block(best, asked, keys, _matrix(b.column("vector"), asked.vectors.shape[1]), row[got], code.take(pa.array(got)).to_numpy(zero_copy_only=False).astype(np.int64), impact, weights, half, matched)
            if kinds is not None:
                h = best.held
                arrays = [asked.ids.take(pa.array(h["query"])), pa.array(h["key"].tolist(), kinds.field(key).type), *map(pa.array, (h["vector"], h["lexical"], h["score"]))]
                yield pa.RecordBatch.from_arrays(arrays, names=["query_id", key, "vector_score", "bm25_score", "score"])

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return search.top_k(found, key, k)


def nearest(queries: DataFrame, vectors: DataFrame, key: str, k: int = 8) -> DataFrame:
    """query_id, key, score, rank: the k rows (key, vector) of the largest cosine for each query (query_id, vector)."""
    none = [F.array().cast("array<string>").alias("tokens")]
    q = queries.select("query_id", *none, F.array().cast("array<double>").alias("weights"), F.col("vector").cast("array<double>").alias("vector"))
    pool = vectors.select(key, *none, F.array().cast("array<int>").alias("counts"), F.lit(0).alias("length"), F.col("vector").cast("array<double>").alias("vector"))
    return top_k(q, pool, key, k, (1.0, 0.0)).select("query_id", key, "score", "rank")
