"""Jaccard join of word shingles by T-occurrence search."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.common import attach, mix, shingles, slices, stage, words
from callweave.llm.graph import components

U64 = np.uint64
#: Shingles of WORDS words; sets link when 100 * intersection >= 75 * union, that is when 7 * intersection >= 3 * (sum of sizes).
WORDS = 5
#: Shingles and sets that a task sorts together.
CHUNK_SHINGLES, CHUNK_SETS = 1_500_000, 60_000
#: Shingles that tasks count COMMON times or more in sets that others share are last in the order of prefixes, the
#: COMMONS most frequent at most. It decides the order of prefixes, never which pairs are found.
COMMON, COMMONS = 24, 400_000
#: Pairs across components that a list may give for each of its sets; a list with more is searched in blocks.
WIDE = 32
#: Sets searched against each other in one block, and rounds of min-hash groups: those for all sets, then those for
#: groups that still hold several components.
BLOCK, ROUNDS, AGAIN = 64, 3, 4
#: Sets in a part of a wide list, of which two meet in a block.
PART = 128
MU = 0.01
#: An identifier of a shingle is its bucket and ID_BITS bits of its hash; the place that stands for several sets.
ID_BITS, SEVERAL = 40, 0xFFFF
REQUEST, PASS = 0, 1


def _sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for i, data, at in slices(texts):
        h, first, _, _ = words(data, at)
        s, doc = shingles(h, first, WORDS)
        order = np.lexsort((s, doc))
        s, doc = s[order], doc[order]
        keep = np.concatenate([[True], (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])])[: len(s)]
        s, doc = s[keep], doc[keep]
        for k, part in enumerate(np.split(s, np.searchsorted(doc, np.arange(1, len(at) - 1)))):
            yield i + k, part


def _key(s: np.ndarray) -> bytes:
    """128 bits of a set, whatever its order."""
    a, b = (int(mix(s ^ U64(x)).sum(dtype=U64)) for x in (0xA5A5A5A55A5A5A5A, 0x3C6EF372FE94F82B))
    return mix(np.array([(a + len(s)) & (1 << 64) - 1, b], U64)).tobytes()


def _need(n: np.ndarray | int) -> np.ndarray | int:
    """Shingles that a set of n must share with another to link with it."""
    return -(-3 * n // 4)


class _Chunk:
    """Sets of the rows that a task reads, each once, until they are sent on."""

    def __init__(self, shingles: int, sets: int) -> None:
        self.limits = shingles, sets
        self.place: dict[bytes, int] = {}
        self.sets: list[np.ndarray] = []
        self.docs: list[int | None] = []
        self.of: list[int] = []
        self.total = 0

    def add(self, doc_id: int | None, s: np.ndarray) -> None:
        at = -1
        if len(s):
            k = _key(s)
            at = self.place.get(k, -1)
            if at < 0:
                at = self.place[k] = len(self.sets)
                self.sets.append(s)
                self.total += len(s)
        self.docs.append(doc_id)
        self.of.append(at)

    def full(self) -> bool:
        return self.total >= self.limits[0] or len(self.sets) >= self.limits[1] or len(self.docs) >= 8 * self.limits[1]


_MAP = pa.schema([("dest", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int64()), ("ids", pa.binary()), ("places", pa.binary()), ("more", pa.binary())])
_MAP_DDL = "dest long, kind int, chunk long, ids binary, places binary, more binary"


def _requests(docs: DataFrame, buckets: int) -> DataFrame:
    """Which shingles of a chunk are in its other sets as well, and requests, by bucket, to find the rest elsewhere. A
    shingle of several sets of the chunk asks once, for the others' sake, so that none weighs more than its chunks."""

    def sent(c: _Chunk, chunk: int) -> Iterator[pa.RecordBatch]:
        n = np.array([len(s) for s in c.sets], np.int64)
        null = np.array([d is None for d in c.docs], np.uint8)
        roster = [np.array([d or 0 for d in c.docs], np.int64), null, np.array(c.of, np.int32), n]
        head = np.array([len(c.docs), len(c.sets)], np.int64).tobytes() + b"".join(x.tobytes() for x in roster) + b"".join(c.place)
        rows = [(chunk, PASS, chunk, b"", b"", head)]
        if c.sets:
            h, at = np.concatenate(c.sets), np.repeat(np.arange(len(n)), n).astype(np.uint16)
            bucket = ((h >> U64(ID_BITS + 4)) % U64(buckets)).astype(np.int64)
            ids = bucket << ID_BITS | (h & U64((1 << ID_BITS) - 1)).astype(np.int64)
            order = np.argsort(ids, kind="stable")
            ids, at = ids[order], at[order]
            new = np.concatenate([[True], ids[1:] != ids[:-1]])
            alone = new & np.append(new[1:], True)
            if not alone.all():
                rows.append((chunk, PASS, chunk, ids[~alone].tobytes(), at[~alone].tobytes(), b""))
            ids, at = ids[new], np.where(alone, at, SEVERAL)[new].astype(np.uint16)
            edge = np.searchsorted(ids, np.arange(buckets + 1) << ID_BITS)
            low, high = ids.astype(np.uint32), (ids >> 32 & 0xFF).astype(np.uint8)
            for b in np.flatnonzero(np.diff(edge)).tolist():
                x, y = edge[b], edge[b + 1]
                rows.append((b, REQUEST, chunk, low[x:y].tobytes() + high[x:y].tobytes(), at[x:y].tobytes(), b""))
        for i in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 256], strict=True), _MAP.types, strict=True)], schema=_MAP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, chunk = _Chunk(CHUNK_SHINGLES, CHUNK_SETS), TaskContext.get().partitionId() << 24
        for b in batches:
            ids = b.column(0).cast(pa.int64()).to_pylist()
            for i, s in _sets(b.column(1)):
                c.add(ids[i], s)
                if c.full():
                    yield from sent(c, chunk)
                    c, chunk = _Chunk(CHUNK_SHINGLES, CHUNK_SETS), chunk + 1
        if c.docs:
            yield from sent(c, chunk)

    return docs.select("doc_id", "text").mapInArrow(run, _MAP_DDL)


def _answered(requests: DataFrame) -> DataFrame:
    """Answers, by chunk: the shingles asked for that other chunks have as well; what is not a request passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, places, chunks = [], [], []
        for b in batches:
            ask = b.column(1).to_numpy() == REQUEST
            yield b.filter(pa.array(~ask))
            for r in b.filter(pa.array(ask)).to_pylist():
                n = len(r["places"]) // 2
                low, high = np.frombuffer(r["ids"], np.uint32, n), np.frombuffer(r["ids"], np.uint8, n, 4 * n)
                ids.append(r["dest"] << ID_BITS | high.astype(np.int64) << 32 | low)
                places.append(np.frombuffer(r["places"], np.uint16))
                chunks.append(np.full(n, r["chunk"]))
        if not ids:
            return
        ids, places, chunks = (np.concatenate(x) for x in (ids, places, chunks))
        order = np.argsort(ids, kind="stable")
        ids, places, chunks = ids[order], places[order], chunks[order]
        new = np.concatenate([[True], ids[1:] != ids[:-1]])
        keep = ~(new & np.append(new[1:], True)) & (places != SEVERAL)
        ids, places, chunks = ids[keep], places[keep], chunks[keep]
        order = np.argsort(chunks, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], np.diff(chunks[order]) > 0])) if len(order) else np.zeros(0, int)
        rows = []
        for part in np.split(order, edge[1:]) if len(order) else []:
            rows.append((0, PASS, int(chunks[part[0]]), ids[part].tobytes(), places[part].tobytes(), b""))
        for i in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 256], strict=True), _MAP.types, strict=True)], schema=_MAP)

    return requests.repartition("dest").mapInArrow(run, _MAP_DDL)


ROWS = "doc_id long, n long, key binary, s binary, mins array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, n, the size of its set, and key, which equal sets share (null for n = 0). Beside
    them, with s and no doc_id, a row per chunk and set that may link: the sorted identifiers of the shingles that other
    sets (or the same in another chunk) have as well, with ROUNDS + AGAIN min-hashes. A set with fewer of these than it must
    share with one other links with none: most sets end here, before any pair is thought of."""
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("s", pa.binary()), ("mins", pa.list_(pa.int64()))])

    def chunk(parts: list[tuple[bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        (head,) = [x for _, _, x in parts if x]
        rows, k = np.frombuffer(head, np.int64, 2).tolist()
        at = 16
        got = []
        for size, dtype in ((rows, np.int64), (rows, np.uint8), (rows, np.int32), (k, np.int64)):
            got.append(np.frombuffer(head, dtype, size, at))
            at += got[-1].nbytes
        doc, null, of, n = got
        keys = [head[at + 16 * i : at + 16 * i + 16] for i in range(k)]
        for i in range(0, rows, 10_000):
            some = of[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(doc[i : i + 10_000], mask=null[i : i + 10_000] > 0), pa.array([int(n[j]) if j >= 0 else 0 for j in some], pa.int64()), pa.array([keys[j] if j >= 0 else None for j in some], pa.binary()), pa.nulls(len(some), pa.binary()), pa.nulls(len(some), kind.types[4])], schema=kind)
        ids = np.concatenate([np.frombuffer(x, np.int64) for x, _, _ in parts])
        place = np.concatenate([np.frombuffer(x, np.uint16) for _, x, _ in parts])
        order = np.lexsort((ids, place))
        ids, edge = ids[order], np.searchsorted(place[order], np.arange(k + 1))
        out = []
        for i in np.flatnonzero((np.diff(edge) >= _need(n)) & (n > 0)).tolist():
            s = ids[edge[i] : edge[i + 1]]
            out.append((None, int(n[i]), keys[i], s.tobytes(), [int(mix(s.view(U64) + U64(r)).min().view(np.int64)) for r in range(ROUNDS + AGAIN)]))
            if len(out) == 256 or i == k - 1:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kind.types, strict=True)], schema=kind)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kind.types, strict=True)], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            for c, ids, places, more in zip(*[b.column(j).to_pylist() for j in (2, 3, 4, 5)], strict=True):
                if c != now and parts:
                    yield from chunk(parts)
                    parts = []
                now = c
                parts.append((ids, places, more))
        if parts:
            yield from chunk(parts)

    return _answered(_requests(docs, buckets)).repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, ROWS)


#: Sorted identifiers of common shingles, and the place of each by frequency, from 1.
Common = tuple[np.ndarray, np.ndarray]


def common_shingles(sets: DataFrame) -> Common:
    """Shingles that tasks count COMMON times or more among sets: those over the lowest power of two that COMMONS of
    them at most reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
            u, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(u[n > 1]), pa.array(n[n > 1])], names=["s", "n"])

        parts, size = [], 0
        for b in batches:
            for s in b.column(0).to_pylist():
                parts.append(np.frombuffer(s, np.int64))
                size += len(parts[-1])
                if size > 4_000_000:
                    yield counted(parts)
                    parts, size = [], 0
        if parts:
            yield counted(parts)

    sums = stage(sets.select("s").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON), "common")
    have, least = 0, None
    for power, k in sorted(sums.groupBy(F.floor(F.log2("n")).alias("p")).count().collect(), reverse=True):
        have += k
        if have <= COMMONS:
            least = 2**power
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = sums.filter(F.col("n") >= least).toArrow()
    ids, n = got["s"].to_numpy(), got["n"].to_numpy()
    place = np.empty(len(ids), np.int64)
    place[np.lexsort((ids, n))] = np.arange(1, len(ids) + 1)
    order = np.argsort(ids)
    return ids[order], place[order]


def t_occurrence(sets: list[np.ndarray], sizes: list[int] | None = None, groups: list[int] | None = None, forest: bool = False, apart: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(i, j, overlap) of the linked pairs i < j of sorted sets; sizes, of which sets hold the shared members, are their
    own if none are given. Sets of one group are not compared, nor those that the matrix `apart` marks; with forest, nor
    are sets that found links connect, and an overlap is only counted up to what links.

    Each set is a query with T, what it must share. Inverted lists with the same sets count as one list of their number
    (weight). Of the query's lists the longest are set aside, while their weight stays under T and DivideSkip's share
    T / (MU log2(longest) + 1); a heap merges the short ones, and sets whose weights reach T less the weight set aside
    are probed for in the long ones by binary search."""
    k = len(sets)
    if k < 2:
        return []
    size = np.array(sizes if sizes is not None else [len(s) for s in sets])
    names, root = {}, np.arange(k)
    for i, g in enumerate(groups or []):
        root[i] = names.setdefault(g, i)
    token, owner = np.concatenate(sets), np.repeat(np.arange(k), [len(s) for s in sets])
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, int)
    length = np.diff(np.append(begin, len(token)))
    begin, length = begin[length > 1], length[length > 1]
    if not len(begin):
        return []
    total = np.concatenate([[U64(0)], np.cumsum(mix(owner.astype(U64) + U64(1)), dtype=U64)])
    mark = total[begin + length] - total[begin]
    _, first, weight = np.unique(mark, return_index=True, return_counts=True)
    lists = [owner[begin[x] : begin[x] + length[x]] for x in first]
    of: list[list[int]] = [[] for _ in range(k)]
    for x, own in enumerate(lists):
        for i in own.tolist():
            of[i].append(x)
    out = []
    for i in range(k - 1):
        allowed = (4 * np.minimum(size, size[i]) >= 3 * np.maximum(size, size[i])) & (root != root[i])
        allowed[: i + 1] = False
        if apart is not None:
            allowed &= ~apart[i]
        if not allowed.any() or not of[i]:
            continue
        t = int(_need(size[i]))
        mine = []
        for x in of[i]:
            own = lists[x][allowed[lists[x]]]
            if len(own):
                mine.append((len(own), int(weight[x]), own.tolist()))
        if sum(w for _, w, _ in mine) < t:
            continue
        mine.sort(key=lambda m: -m[0])
        most = min(t - 1, t / (MU * np.log2(mine[0][0] + 1) + 1))
        aside, far = 0, 0
        while far < len(mine) and mine[far][0] > 4 and aside + mine[far][1] <= most:
            aside += mine[far][1]
            far += 1
        short = mine[far:]
        heap = [(own[0], x, 0) for x, (_, _, own) in enumerate(short)]
        heapq.heapify(heap)
        found: list[tuple[int, int]] = []
        while heap:
            j, count = heap[0][0], 0
            while heap and heap[0][0] == j:
                _, x, at = heap[0]
                count += short[x][1]
                own = short[x][2]
                if at + 1 < len(own):
                    heapq.heapreplace(heap, (own[at + 1], x, at + 1))
                else:
                    heapq.heappop(heap)
            if count >= t - aside:
                found.append((j, count))
        for j, count in found:
            if forest and root[j] == root[i]:
                continue
            need, left = -(-3 * int(size[i] + size[j]) // 7), aside
            for _, w, own in reversed(mine[:far]):
                if count + left < need or (forest and count >= need):
                    break
                left -= w
                at = bisect_left(own, j)
                if at < len(own) and own[at] == j:
                    count += w
            if count >= need:
                out.append((i, j, count))
                if forest:
                    root[root == root[j]] = root[i]
    return out


def _prefix(s: np.ndarray, n: int, common: Common) -> tuple[np.ndarray, np.ndarray]:
    """The first m - need + 1 of m shared shingles, of which linked sets share one at least, and their late: 0, or a
    common one's place. Common ones are last, the most frequent at the end."""
    ids, place = common
    late = np.zeros(len(s), np.int64)
    if len(ids):
        at = np.minimum(np.searchsorted(ids, s), len(ids) - 1)
        late = np.where(ids[at] == s, place[at], 0)
    order = np.argsort(late, kind="stable")[: len(s) - int(_need(n)) + 1]
    return s[order], late[order]


def _met_before(sets: list[np.ndarray], sizes: list[int], common: Common, list_: int) -> np.ndarray:
    """Which pairs share a prefix shingle that comes before list_, so that its list, not this one, is theirs."""
    out = np.zeros((len(sets), len(sets)), bool)
    own: dict[int, list[int]] = {}
    for i, (s, n) in enumerate(zip(sets, sizes, strict=True)):
        for x in _prefix(s, n, common)[0].tolist():
            if x == list_:
                break
            own.setdefault(x, []).append(i)
    for at in own.values():
        if len(at) > 1:
            out[np.ix_(at, at)] = True
    return out


def search(rows: DataFrame, common: Common | None = None) -> DataFrame:
    """a, b: links inside blocks of rows (block, sid, n, s, label, list) that join what is linked there; a label's sets
    count as joined already. If list isn't null, the block is of sets in this prefix shingle's list, and pairs that meet
    in an earlier list are left to that. A task holds one block at a time."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    bc = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, links = None, [], []

        def found() -> None:
            sets, sizes = [np.frombuffer(r[2], np.int64) for r in held], [r[1] for r in held]
            apart = _met_before(sets, sizes, bc.value, held[0][4]) if held and held[0][4] is not None else None
            links.extend((held[i][0], held[j][0]) for i, j, _ in t_occurrence(sets, sizes, [r[3] for r in held], True, apart))

        for b in batches:
            for block, *r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if block != now:
                    found()
                    now, held = block, []
                held.append(r)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], schema=kind)
                links.clear()
        found()
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], schema=kind)

    columns = ["block", "sid", "n", "s", "label", "list"]
    return rows.select(*columns).repartition("block").sortWithinPartitions("block", "n", "sid").mapInArrow(run, "a long, b long")


def _grouped(sets: DataFrame, rounds: range, total: int, labels: DataFrame | None = None) -> DataFrame:
    """Links inside the min-hash groups of these rounds, dealt into blocks; of several labels, if there are labels."""
    picked = F.slice("mins", rounds.start + 1, len(rounds))
    thin = sets.select("sid", F.posexplode(picked).alias("round", "m")).select("sid", F.xxhash64("round", "m").alias("g"))
    if labels is not None:
        thin = thin.join(labels.withColumnRenamed("node", "sid"), "sid", "left")
    thin = thin.withColumn("label", F.coalesce("label", "sid") if labels is not None else F.col("sid"))
    sizes = thin.groupBy("g").agg(F.count(F.lit(1)).alias("__n"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").drop("lo", "hi")
    dealt = attach(thin, sizes, "g", "__n", total).filter("__n > 1")
    dealt = dealt.select("sid", "label", F.xxhash64("g", F.pmod(F.xxhash64("sid", "g"), F.ceil(F.col("__n") / BLOCK))).alias("block"))
    return search(dealt.join(sets.select("sid", "n", "s"), "sid").withColumn("list", F.lit(None).cast("long")))


def _dealt(mixed: DataFrame, per: DataFrame) -> DataFrame:
    """sid, list, block: the sets of wide lists in parts, every part with each other part. A label that
    fills parts of its own isn't met with itself. mixed: s, sid, label of wide lists; per: s, label, k of these lists."""
    big = F.col("k") > PART
    own = per.withColumn("own", F.when(big, F.ceil(F.col("k") / PART)).otherwise(0).cast("int"))
    w = Window.partitionBy("s").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.filter("own > 0").withColumn("off", F.coalesce(F.sum("own").over(w), F.lit(0)).cast("int")).select("s", "label", "own", "off")
    sums = own.groupBy("s").agg(F.ceil(F.sum(F.when(~big, F.col("k")).otherwise(0)) / PART).cast("int").alias("pool"), F.sum("own").cast("int").alias("rest"))
    at = mixed.join(sums, "s").join(starts, ["s", "label"], "left")
    h = lambda n: F.pmod(F.xxhash64("sid", F.lit(7)), n).cast("int")
    i = F.when(F.col("own") > 0, F.col("pool") + F.col("off") + h(F.col("own"))).otherwise(h(F.greatest("pool", F.lit(1))))
    every = F.sequence(F.lit(0), F.col("pool") + F.col("rest") - 1)
    others = F.when(F.col("own") > 0, F.filter(every, lambda o: (o < F.col("pool") + F.col("off")) | (o >= F.col("pool") + F.col("off") + F.col("own")))).otherwise(every)
    met = at.withColumn("i", i).withColumn("o", F.explode(others))
    return met.select("sid", F.col("s").alias("list"), F.xxhash64("s", F.least("i", "o"), F.greatest("i", "o")).alias("block"))


def prefixes(sets: DataFrame, common: Common) -> DataFrame:
    """sid, label, n, m, late, s, pos: a row for each prefix shingle of each set."""
    bc = sets.sparkSession.sparkContext.broadcast(common)
    kind = pa.schema([("sid", pa.int64()), ("label", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("late", pa.int64()), ("s", pa.int64()), ("pos", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = bc.value
        for b in batches:
            sid, label, n = (c.to_numpy() for c in b.columns[:3])
            sets = [np.frombuffer(x, np.int64) for x in b.column(3).to_pylist()]
            m = np.array([len(s) for s in sets], np.int64)
            parts, lates = [], []
            for x in map(_prefix, sets, n.tolist(), [hot] * len(sets)):
                parts.append(x[0])
                lates.append(x[1])
            k = np.array([len(x) for x in parts], np.int64)
            pos = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            if len(pos):
                yield pa.RecordBatch.from_arrays([*[pa.array(np.repeat(x, k)) for x in (sid, label, n, m)], pa.array(np.concatenate(lates)), pa.array(np.concatenate(parts)), pa.array(pos)], schema=kind)

    return sets.select("sid", "label", "n", "s").mapInArrow(run, "sid long, label long, n long, m long, late long, s long, pos long")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([np.frombuffer(v, np.int64) for v in b.column(c).to_pylist()] for c in (2, 4))
            n = b.column(3).to_numpy() + b.column(5).to_numpy()
            ok = [7 * len(np.intersect1d(p, q, assume_unique=True)) >= 3 * k for p, q, k in zip(x, y, n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    s = lambda c: sets.select(F.col("sid").alias(c), F.col("s").alias(f"s{c}"), F.col("n").alias(f"n{c}"))
    return pairs.join(s("a"), "a").join(s("b"), "b").select("a", "b", "sa", "na", "sb", "nb").mapInArrow(run, "a long, b long")


def links(sets: DataFrame, total: int) -> DataFrame:
    """node, label: of the sets (sid, n, s, mins) that link with another, the smallest sid of what links join.

    First sets that share a min-hash are searched in blocks, which joins nearly all that links join. Then every list of
    a prefix shingle is looked at whose sets are still of different labels; lists of the same sets once. Their pairs
    across labels, of sizes and with so much behind the shingle that they can link, are verified each; a list with more
    than WIDE such pairs a set is searched in blocks instead. No pair that links is left out: it has a first common
    prefix shingle."""
    first = stage(_grouped(sets, range(ROUNDS), total), "links")
    labels = stage(components(first), "labels")
    second = stage(_grouped(sets, range(ROUNDS, ROUNDS + AGAIN), total, labels), "links")
    found = first.unionByName(second)
    labels = stage(components(found), "labels")
    named = stage(sets.select("sid", "n", "s").join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid")), "sets")
    common = common_shingles(named)
    entries = stage(prefixes(named, common), "prefixes")
    per = entries.groupBy("s", "label").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("sid")).alias("sig"), F.min("late").alias("late"))
    lists = per.groupBy("s").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("same"), F.bit_xor("sig").alias("sig"), F.min("late").alias("late"), (F.min("label") < F.max("label")).alias("several"))
    once = lists.filter("several").groupBy("sig", "k", "same").agg(F.min(F.struct("late", "s")).alias("x"))
    lists = stage(once.select(F.col("x.s").alias("s"), ((F.col("k") * F.col("k") - F.col("same")) / 2 > WIDE * F.col("k")).alias("wide")), "lists")
    mixed = entries.drop("late").join(lists, "s")
    side = lambda c: mixed.filter("not wide").select("s", *[F.col(x).alias(f"{x}{c}") for x in ("sid", "label", "n", "m", "pos")])
    least = lambda x: F.least(f"{x}a", f"{x}b")
    fit = (4 * least("n") >= 3 * F.greatest("na", "nb")) & (7 * F.least(F.col("ma") - F.col("posa"), F.col("mb") - F.col("posb")) >= 3 * (F.col("na") + F.col("nb")))
    # labels of a list meet first, then their sets: sets of one label never meet, however many they are
    narrow = per.join(lists.filter("not wide").select("s"), "s")
    across = narrow.select("s", F.col("label").alias("labela")).join(narrow.select("s", F.col("label").alias("labelb")), "s").filter("labela < labelb")
    pairs = across.join(side("a"), ["s", "labela"]).join(side("b"), ["s", "labelb"]).filter(fit)
    more = _verify(pairs.select(F.col("sida").alias("a"), F.col("sidb").alias("b")).distinct(), named.select("sid", "n", "s"))
    wide = lists.filter("wide").select("s")
    if wide.limit(1).count():
        dealt = _dealt(mixed.filter("wide").select("s", "sid", "label"), per.select("s", "label", "k").join(wide, "s"))
        more = more.unionByName(search(dealt.join(named, "sid"), common))
    more = stage(more, "links")
    return components(found.unionByName(more)) if more.limit(1).count() else labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (columns doc_id, text); see the module for the link.

    Rows with equal sets are one class. Sets that share too little with all others together end first (signatures).
    Classes of one size that share the same shingles with others are twins: they link with the same classes, so one of
    them is searched for all (links); twins that link with no other class link with each other if what they share is
    enough. Null and empty texts have no shingles and no links; rows with one doc_id are rows of their own that count in
    its name. Equal sets are recognised by 128 bits, shingles by 64 within a text and by their bucket and 40 bits
    between texts."""
    rows = stage(signatures(docs), "signatures")
    sig = rows.filter("s is null").select("doc_id", "n", "key")
    total = sig.count()
    found = rows.filter("s is not null").select("key", "n", "s", "mins")
    thin = stage(found.groupBy("key").agg(F.max("n").alias("n"), F.max(F.octet_length("s") / 8).cast("long").alias("m"), F.max(F.concat_ws(":", F.sha2("s", 256), "n")).alias("alike")), "thin")
    twins = stage(thin.groupBy("alike").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("twins")).withColumn("sid", F.monotonically_increasing_id()), "twins")
    of = attach(thin, twins.select("alike", "twins", "sid"), "alike", "twins", total)
    sets = stage(found.join(twins.select("key", "sid"), "key").groupBy("sid").agg(F.max("n").alias("n"), F.max("s").alias("s"), F.max("mins").alias("mins")), "sets")
    labels = links(sets, total).withColumnRenamed("node", "sid")
    own = (F.col("twins") > 1) & (7 * F.col("m") >= 6 * F.col("n"))
    named = of.join(labels, "sid", "left").withColumn("label", F.coalesce("label", F.when(own, F.col("sid")))).filter("label is not null").select("key", "label")
    classes = sig.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"))
    joined = stage(classes.join(named, "key"), "classes")
    smallest = joined.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    where = attach(joined.select("key", "label"), smallest, "label", "members", total).select("key", "component_id")
    where = stage(classes.join(where, "key", "left").select("key", "size", F.coalesce("component_id", "least").alias("component_id")), "where")
    out = attach(sig.filter("n > 0"), where, "key", "size", total).drop("size").unionByName(sig.filter("n = 0").withColumn("component_id", F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
