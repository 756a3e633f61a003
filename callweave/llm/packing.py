"""Packing of token runs into sequences of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import stage
from callweave.llm.tokens import default_path, encoder

LENGTH, END = 2048, 0
#: Pieces packed together by one task, and tokens held at once by best-fit decreasing.
GROUP_PIECES, WINDOW_TOKENS = 20_000, 4_000_000


def split(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, the first alone shorter."""
    head = n % length
    return ([(0, head)] if head else []) + [(s, length) for s in range(head, n, length)]


class Capacity:
    """Segment tree over free capacities: counts of open bins, and the least capacity that still holds a need."""

    def __init__(self, top: int):
        self.base = 1 << top.bit_length()
        self.tree, self.bins = [0] * (2 * self.base), [[] for _ in range(top + 1)]

    def add(self, free: int, b: int) -> None:
        self.bins[free].append(b)
        i = free + self.base
        while i:
            self.tree[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        i = need + self.base
        if not self.tree[i]:  # up to the first right sibling that holds bins, then down its left edge
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i *= 2
                i += not self.tree[i]
        free = i - self.base
        while i:
            self.tree[i] -= 1
            i >>= 1
        return free, self.bins[free].pop()


def best_fit(sizes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The bin of each size in the order given: the fullest that still has room, else a new one."""
    out, free, n = np.zeros(len(sizes), np.int64), Capacity(length), 0
    for i, need in enumerate(sizes.tolist()):
        found = free.take(need)
        if found:
            left, b = found
        else:
            left, b, n = length, n, n + 1
        out[i] = b
        free.add(left - need, b)
    return out


def best_fit_decreasing(sizes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The bin of each size, the largest first; equal sizes in the order given."""
    order, out = np.argsort(-sizes, kind="stable"), np.zeros(len(sizes), np.int64)
    out[order] = best_fit(sizes[order], length)
    return out


class LocalSearch:
    """Empties bins by moves and exchanges, each raising the sum of squared fills. The emptiest bin gives a piece to the
    bin it fits best; if none takes any, it gives one piece, or two, for one smaller piece of another bin. It goes on
    with the next emptiest bin when nothing more can be done, and ends when the count of bins meets its lower bound or a
    pass over all bins changes nothing. `moves`, `swaps`, `pairs` and `emptied` count what was done."""

    def __init__(self, sizes: np.ndarray, bins: np.ndarray, length: int = LENGTH):
        self.size, self.bin, self.length = sizes.astype(np.int64), bins.astype(np.int64).copy(), length
        self.fill = np.bincount(bins, self.size, minlength=bins.max(initial=-1) + 1).astype(np.int64)
        self.of: list[list[int]] = [[] for _ in self.fill]
        for i, b in enumerate(bins.tolist()):
            self.of[b].append(i)
        self.items = np.arange(len(sizes))  # those of bins that aren't full; refreshed now and then
        self.tried, self.changed = np.zeros(len(self.fill), bool), False  # in this pass; in this pass at all
        self.moves = self.swaps = self.pairs = self.emptied = 0

    def shift(self, i: int, to: int) -> None:
        b, x = int(self.bin[i]), int(self.size[i])
        self.of[b].remove(i)
        self.of[to].append(i)
        self.bin[i] = to
        self.fill[b] -= x
        self.fill[to] += x
        self.tried[[b, to]] = False
        self.changed = True

    def exchange(self, e: int, x: int, give: tuple[int, ...]) -> bool:
        """The pieces `give` of bin e, x in all, for the one smaller piece elsewhere that raises the squared fills most."""
        at = self.bin[self.items]
        y, fill = self.size[self.items], self.fill[at]
        ok = np.flatnonzero((y < x) & (fill - y + x <= self.length) & (at != e))
        if not len(ok):
            return False
        d = x - y[ok]
        rise = d * (fill[ok] - self.fill[e] + d)
        best = int(ok[np.argmax(rise)])
        if rise.max() <= 0:
            return False
        to, back = int(at[best]), int(self.items[best])
        self.shift(back, e)
        for i in give:
            self.shift(i, to)
        return True

    def step(self, e: int) -> bool:
        """One change that takes tokens out of bin e; False if none raises the squared fills."""
        own = {int(self.size[i]): i for i in self.of[e]}  # pieces of one size are alike
        order = sorted(own, reverse=True)
        for x in order:
            ok = np.flatnonzero((self.fill <= self.length - x) & (self.fill > self.fill[e] - x))
            ok = ok[ok != e]
            if len(ok):
                self.shift(own[x], int(ok[np.argmax(self.fill[ok])]))
                self.moves += 1
                return True
        for x in order:
            if self.exchange(e, x, (own[x],)):
                self.swaps += 1
                return True
        sums: dict[int, tuple[int, int]] = {}
        for i, x in enumerate(order):
            twin = next((k for k in self.of[e] if k != own[x] and self.size[k] == x), None)
            for y, other in [(x, twin)] * (twin is not None) + [(y, own[y]) for y in order[i + 1 :]]:
                sums.setdefault(x + y, (own[x], other))
        for x in sorted(sums, reverse=True):
            if self.exchange(e, x, sums[x]):
                self.pairs += 1
                return True
        return False

    def run(self) -> np.ndarray:
        least, count = -(-int(self.size.sum()) // self.length), int((self.fill > 0).sum())
        while count > least:
            open_ = np.flatnonzero((self.fill > 0) & (self.fill < self.length) & ~self.tried)
            if not len(open_):
                if not self.changed:
                    break
                self.tried[:], self.changed = False, False
                continue
            self.items = self.items[self.fill[self.bin[self.items]] < self.length]
            e = int(open_[np.argmin(self.fill[open_])])
            while self.of[e] and self.step(e):
                pass
            self.tried[e] = True
            if not self.of[e]:
                count, self.emptied = count - 1, self.emptied + 1
                self.fill[e] = self.length  # closed: takes nothing any more
        return self.bin


def local_search(sizes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The bin of each size, from 0 without gaps: best fit in the order given, pieces of over half a bin first, then
    local search."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    start, order = np.zeros(len(sizes), np.int64), np.argsort(2 * sizes <= length, kind="stable")
    start[order] = best_fit(sizes[order], length)
    return np.unique(LocalSearch(sizes, start, length).run(), return_inverse=True)[1]


def token_pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids and end mark; null text is empty."""
    kind = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([END], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = enc.encode(text.as_py()) + end
                rows += [(doc_id, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(split(len(ids) // 4, length))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kind.types, strict=True)], schema=kind)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Ids never leave the task that makes them: lengths alone are packed. Full pieces fill a sequence each; the others are
    dealt by a hash of their place to groups of about GROUP_PIECES, so that copies spread evenly, and each group is
    packed by local search. A group leaves less than one sequence's room more than one packing of all would."""
    rows = stage(token_pieces(docs, path or default_path(), length), "pieces").withColumn("row", F.monotonically_increasing_id())
    part = F.col("length") < length
    groups = max(1, -(-rows.filter(part).count() // GROUP_PIECES))
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        sizes = t["length"].to_numpy()
        at = local_search(sizes, length)
        order = np.argsort(at, kind="stable")
        total = np.cumsum(sizes[order]) - sizes[order]
        begins = np.concatenate([[True], np.diff(at[order]) > 0])
        offset = np.zeros(len(at), np.int64)
        offset[order] = total - np.repeat(total[begins], np.diff(np.append(np.flatnonzero(begins), len(at))))
        sequence = (t["group"].to_numpy() << 32) + at
        return t.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    packed = rows.filter(part).withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy("group").applyInArrow(one, kind)
    full = rows.filter(~part).select("doc_id", "piece", "start", "length", "ids_crc32", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


MATRIX = "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, starts array<long>"


def pack_matrices(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Packed rows ready to train on: `ids`, a row of the id matrix as `length` little-endian unsigned 32-bit numbers
    (END after the last token), `cu_seqlens`, the cumulative lengths of its segments from 0 to n_tokens, `positions`,
    which restart at each segment (32-bit; 0 in the padding), and each segment's document and first token.

    Best-fit decreasing over windows of WINDOW_TOKENS as a task reads them, the bin found by a segment tree over free
    capacities; nothing is shuffled. Documents longer than a row are split into full rows and one shorter piece, so
    that joining a document's pieces by start gives its ids back. Null text is an end mark alone."""
    path = path or default_path()
    kind = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("positions", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])

    def packed(held: list[tuple[int | None, int, bytes]], first: int) -> Iterator[pa.RecordBatch]:
        at = best_fit_decreasing(np.array([len(x[2]) // 4 for x in held]), length)
        order = np.argsort(at, kind="stable")
        for rows in np.array_split(order, np.flatnonzero(np.diff(at[order]) > 0)[127::128] + 1):
            out = []
            for run in np.split(rows, np.flatnonzero(np.diff(at[rows]) > 0) + 1):
                sizes = [len(held[i][2]) // 4 for i in run]
                n = sum(sizes)
                ids = b"".join(held[i][2] for i in run)
                positions = np.concatenate([*[np.arange(s, dtype="<u4") for s in sizes], np.zeros(length - n, "<u4")])
                pad = np.full(length - n, END, "<u4").tobytes()
                out.append((first + int(at[run[0]]), n, ids + pad, np.cumsum([0, *sizes]).tolist(), positions.tobytes(), [held[i][0] for i in run], [held[i][1] for i in run]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kind.types, strict=True)], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([END], "<u4").tobytes()
        held, tokens, first = [], 0, TaskContext.get().partitionId() << 40
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = enc.encode(text.as_py()) + end
                held += [(doc_id, s, ids[4 * s : 4 * (s + n)]) for s, n in split(len(ids) // 4, length)]
                tokens += len(ids) // 4
                if tokens >= WINDOW_TOKENS:
                    yield from packed(held, first)
                    held, tokens, first = [], 0, first + len(held)
        if held:
            yield from packed(held, first)

    return docs.select("doc_id", "text").mapInArrow(run, MATRIX)


def write_matrices(docs: DataFrame, path: str, tokenizer: str | None = None, length: int = LENGTH) -> None:
    """The packed rows as Parquet files of binary rows in a folder of any store that Spark writes to."""
    pack_matrices(docs, tokenizer, length).write.parquet(path)
