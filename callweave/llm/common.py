"""Shared pieces of the training-data operators: staging, text hashing, group joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.plans.staging import forget, stage  # noqa: F401  used by the operators through this module

U64 = np.uint64
#: Bytes of text hashed at once; a longer document is hashed alone.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, mod m; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=U64))[_LOW]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_POW: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size > 8 * SLICE_BYTES:
            return have
        _POW[base] = have
    return have[:n]


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of a text column; null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, "right")) - 1)
        yield i, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` with A-Z lowered, the first word of each document
    (and a last bound), and each word's first and past-last byte."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), np.zeros(len(at), np.int64), none, none
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    starts = np.flatnonzero(inside & (cut[:-1] | np.concatenate([[True], ~inside[:-1]])))
    ends = np.flatnonzero(inside & (cut[1:] | np.concatenate([~inside[1:], [True]]))) + 1
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=total[1:])
    h = mix((total[ends] - total[starts]) * _powers(_INV, len(data))[starts])
    return h, np.searchsorted(starts, at), starts, ends


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words and the document of each; fewer words make one whole-sequence shingle."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), np.maximum(n - k + 1, 0))
    out = np.zeros(0, U64)
    if len(h) >= k:
        run = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            run = run * U64(_BASE) + h[i : len(h) - k + 1 + i]
        begin = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(n - k + 1, 0)) - np.maximum(n - k + 1, 0), np.maximum(n - k + 1, 0)) + first[:-1][doc]
        out = mix(run[begin])
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = np.zeros(len(short), U64)
        for i in range(k - 1):
            more = n[short] > i
            whole[more] = whole[more] * U64(_BASE) + h[first[:-1][short[more]] + i]
        whole = mix(whole + U64(0x5851F42D4C957F2D) * n[short].astype(U64))
        out, doc = np.concatenate([out, whole]), np.concatenate([doc, short])
    return out, doc


def attach(left: DataFrame, groups: DataFrame, key: str, size: str, rows: int) -> DataFrame:
    """left ⟕ groups on key, groups having one row a key. Groups of over a thousandth of all rows, of which there
    are fewer than a thousand, are broadcast, so no hot key meets in one task; the rest join by shuffle."""
    least = max(rows // 1000, 32)
    hot, cold = groups.filter(F.col(size) > least), groups.filter(F.col(size) <= least)
    far = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return left.join(F.broadcast(hot), key).unionByName(far.select(*left.columns, *[c for c in groups.columns if c != key]))
