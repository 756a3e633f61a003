"""Class-based bigram language model: exchange clustering, class transitions, word emissions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import crc_mod, slices, stage, words

#: Most frequent words, with shapes for all others, that a first exchange on the driver clusters; classes; its passes;
#: then passes over the text in which every word sent may change its class; the words whose counts and classes every
#: task is sent, the most frequent; and the mass added to counts. Words beyond those sent are in the class of their
#: shape and keep their own emission probability, looked up by a join.
SEED_WORDS, CLASSES, PASSES, ROUNDS, SENT_WORDS, ADD = 600, 48, 8, 2, 150_000, 0.1
LAST = (b".", b",", b"!", b"?", b"%&$*#|")
SHAPES = (len(LAST) + 1) * 2 * 4 * 4
END = np.uint64(0x5CA1AB1E0DDBA11)
U64 = np.uint64
_LAST = np.zeros(256, np.int64)
for _i, _s in enumerate(LAST):
    _LAST[list(_s)] = _i + 1


def shape(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A word's shape from its last byte, its length, whether it is all ASCII, and the byte before the last."""
    high = np.concatenate([[0], np.cumsum(data >= 128)])
    size = np.minimum((ends - starts - 1) // 3, 3)
    before = data[np.maximum(ends - 2, starts)].astype(np.int64) % 4
    return ((_LAST[data[ends - 1]] * 2 + (high[ends] > high[starts])) * 4 + size) * 4 + before


def _sorted_index(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


@dataclass
class Sent:
    """What every task knows: sorted hashes, counts and classes of the most frequent words, and the classes of shapes
    and of the end mark, by which all others go. `seed` is the place among the first words clustered, or -1."""

    keys: np.ndarray
    counts: np.ndarray
    seed: np.ndarray
    classes: np.ndarray
    shapes: np.ndarray
    end: int = 0

    def units(self, h: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        """Of the first clustering: a seed word's place, else its shape's."""
        at = _sorted_index(self.keys, h)
        own = np.where(at >= 0, self.seed[at], -1) if len(self.keys) else np.full(len(h), -1)
        return np.where(own >= 0, own, SEED_WORDS + 1 + shapes)

    def places(self, h: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the keys or -1, class) of each word."""
        at = _sorted_index(self.keys, h)
        return at, np.where(at >= 0, self.classes[at], self.shapes[shapes]) if len(self.keys) else self.shapes[shapes]


UNITS = SEED_WORDS + 1 + SHAPES  # SEED_WORDS is the end mark's unit


def word_counts(docs: DataFrame) -> DataFrame:
    """h, shape, c of all words of the training rows and the end mark, whose shape is -1; counted within tasks first."""
    kind = pa.schema([("h", pa.int64()), ("shape", pa.int32()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, s, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            u, first, back = np.unique(h, return_index=True, return_inverse=True)
            return u, s[first], np.bincount(back, c, minlength=len(u)).astype(np.int64)

        def batch(p: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(p[0].view(np.int64)), pa.array(p[1].astype(np.int32)), pa.array(p[2])], schema=kind)

        parts, waiting, rows = [], 0, 0
        for b in batches:
            rows += b.num_rows
            for _, data, at in slices(b.column(0)):
                h, _, starts, ends = words(data, at)
                parts.append((h, shape(data, starts, ends), np.ones(len(h), np.int64)))
                waiting += len(h)
                if waiting > 2_000_000:
                    parts = [merged(parts)]
                    waiting = len(parts[0][0])
                    if waiting > 1_500_000:
                        yield batch(parts[0])
                        parts, waiting = [], 0
        if parts:
            yield batch(merged(parts))
        if rows:
            yield batch((np.array([END]), np.array([-1]), np.array([rows])))

    return docs.select("text").mapInArrow(run, "h long, shape int, c long").groupBy("h").agg(F.max("shape").alias("shape"), F.sum("c").alias("c"))


def transitions(docs: DataFrame, sent: Sent) -> np.ndarray:
    """Counts of unit pairs over the training rows, an end mark before and after each: at most UNITS squared numbers."""
    bc = docs.sparkSession.sparkContext.broadcast(sent)
    kind = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros(UNITS * UNITS, np.int64)
        for b in batches:
            for _, data, at in slices(b.column(0)):
                h, first, starts, ends = words(data, at)
                line = np.insert(bc.value.units(h, shape(data, starts, ends)), first, SEED_WORDS)  # an end mark before each document and after the last
                np.add.at(m, line[:-1] * UNITS + line[1:], 1)
        some = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(m[some])], schema=kind)

    got = docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(UNITS * UNITS)
    out[got["pair"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(UNITS, UNITS)


def exchange(b: np.ndarray, classes: int, passes: int = PASSES, fixed: int = SEED_WORDS) -> np.ndarray:
    """The class of each unit: starting from units dealt by frequency, each in turn goes to the class that raises the
    likelihood of the class bigrams most, until a pass changes none. The end mark keeps class 0 to itself."""
    n = b.sum(1) + b.sum(0)
    order = np.argsort(-n, kind="stable")
    at = np.zeros(len(b), np.int64)
    rest = order[order != fixed]
    at[rest] = 1 + np.minimum(np.arange(len(rest)), np.arange(len(rest)) % (classes - 1))
    one = np.eye(classes)[at]
    c = one.T @ b @ one
    xlog = lambda v: v * np.log(np.maximum(v, 1e-300))

    def gains(u: int, k: int) -> np.ndarray:
        """Likelihood without u's class k, then for u in each class, as far as classes' rows, columns and sums go."""
        out, into, self_ = b[u] @ one, b[:, u] @ one, b[u, u]
        out[k] -= self_
        into[k] -= self_
        base = c.copy()  # without u
        base[k] -= out
        base[:, k] -= into
        base[k, k] -= self_
        row, col = base.sum(1) + into, base.sum(0) + out  # steps to and from u count wherever it goes
        j = np.arange(classes)
        after_r, after_c = base + out[None, :], base + into[:, None]  # [j, x] row j with u; [x, j] column j with u
        rows = xlog(after_r).sum(1) - xlog(base).sum(1)
        cols = xlog(after_c).sum(0) - xlog(base).sum(0)
        corner = xlog(base[j, j] + out + into + self_) - xlog(base[j, j] + out) - xlog(base[j, j] + into) + xlog(base[j, j])
        du, iu = out.sum() + self_, into.sum() + self_
        return rows + cols + corner - (xlog(row + du) - xlog(row)) - (xlog(col + iu) - xlog(col))

    for _ in range(passes):
        changed = 0
        for u in rest:
            if n[u] == 0:
                continue
            k = int(at[u])
            g = gains(u, k)
            g[0] = -np.inf
            new = int(np.argmax(g))
            if new != k and g[new] > g[k] + 1e-9:
                out, into = b[u] @ one, b[:, u] @ one
                c[k] -= out
                c[:, k] -= into
                c[k, k] += b[u, u]
                one[u, k], one[u, new], at[u] = 0, 1, new
                out, into = b[u] @ one, b[:, u] @ one
                c[new] += out
                c[:, new] += into
                c[new, new] -= b[u, u]
                changed += 1
        if not changed:
            break
    return at


def class_pairs(docs: DataFrame, sent: Sent) -> np.ndarray:
    """Counts of class pairs over the training rows, an end mark before and after each."""
    bc = docs.sparkSession.sparkContext.broadcast(sent)
    kind = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros(CLASSES * CLASSES, np.int64)
        for b in batches:
            for _, data, at in slices(b.column(0)):
                h, first, starts, ends = words(data, at)
                line = np.insert(bc.value.places(h, shape(data, starts, ends))[1], first, bc.value.end)
                m += np.bincount(line[:-1] * CLASSES + line[1:], minlength=len(m))
        some = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(m[some])], schema=kind)

    got = docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES * CLASSES)
    out[got["pair"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(CLASSES, CLASSES)


def best_classes(context: np.ndarray, n: np.ndarray, now: np.ndarray, pairs: np.ndarray, end: int = 0) -> np.ndarray:
    """The class of each word in which its neighbours are likeliest. context[w]: counts of the classes before it, then of
    those after; n: its count; pairs: class pairs. A word's own counts leave its present class first, so that it isn't
    held there by itself; the end mark's class takes no word, and a tie stays."""
    k, own = len(pairs), np.arange(len(n))
    before, after, row = context[:, :k].astype(float), context[:, k:].astype(float), pairs.sum(1)
    log = lambda x: np.log(np.maximum(x, 0) + ADD)
    # log P(what follows | class) + log P(class | what is before) + log P(word | class), the word's own share left out
    score = after @ log(pairs).T + before @ log(pairs) - 2 * n[:, None] * log(row)
    alone = (after * log(pairs[now] - after)).sum(1) + (before * log(pairs[:, now].T - before)).sum(1) - 2 * n * log(row[now] - n)
    score[own, now] = alone
    score[:, end] = -np.inf
    best = score.argmax(1)
    return np.where(score[own, best] > score[own, now] + 1e-9, best, now)


def reassigned(docs: DataFrame, sent: Sent, pairs: np.ndarray) -> Sent:
    """One pass of the exchange over all words sent at once: their neighbours' classes are counted in the text, word by
    word in one task each, and every word goes to its best class. What comes back is a number a word that moves."""
    sc = docs.sparkSession.sparkContext
    bc = sc.broadcast((sent, pairs))
    span, k = 1024, CLASSES  # words of a bucket
    kind = pa.schema([("bucket", pa.int64()), ("codes", pa.binary()), ("n", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bc.value[0]

        def out(codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.searchsorted(codes, np.arange(0, len(known.keys) + span, span) * 2 * k)
            rows = [(b, codes[x:y].tobytes(), n[x:y].astype(np.int32).tobytes()) for b, (x, y) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)) if x < y]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, kind.types, strict=True)], schema=kind)

        parts, waiting = [], 0
        for b in batches:
            for _, data, at in slices(b.column(0)):
                h, first, starts, ends = words(data, at)
                place, cls = known.places(h, shape(data, starts, ends))
                line, who = np.insert(cls, first, known.end), np.insert(place, first, -1)
                i = np.flatnonzero(who >= 0)
                codes = np.concatenate([who[i] * 2 * k + line[i - 1], who[i] * 2 * k + k + line[i + 1]])
                parts.append(np.unique(codes, return_counts=True))
                waiting += len(parts[-1][0])
                if waiting > 3_000_000:
                    yield from out(*_summed(parts))
                    parts, waiting = [], 0
        if parts:
            yield from out(*_summed(parts))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, m = bc.value
        parts = [(np.frombuffer(c, np.int64), np.frombuffer(n, np.int32)) for b in batches for c, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        if not parts:
            return
        codes, n = _summed(parts)
        word, back = np.unique(codes // (2 * k), return_inverse=True)
        for i in range(0, len(word), 8192):
            some = (back >= i) & (back < i + 8192)
            context = np.zeros((min(8192, len(word) - i), 2 * k))
            context[back[some] - i, codes[some] % (2 * k)] = n[some]
            w = word[i : i + 8192]
            new = best_classes(context, context[:, :k].sum(1), known.classes[w], m, known.end)
            moved = new != known.classes[w]
            yield pa.RecordBatch.from_arrays([pa.array(w[moved]), pa.array(new[moved])], names=["w", "c"])

    got = docs.select("text").mapInArrow(count, "bucket long, codes binary, n binary").repartition("bucket").mapInArrow(choose, "w long, c long").toArrow()
    classes = sent.classes.copy()
    classes[got["w"].to_numpy()] = got["c"].to_numpy()
    return replace(sent, classes=classes)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(back, np.concatenate([n for _, n in parts]), minlength=len(codes)).astype(np.int64)


@dataclass
class Model:
    sent: Sent
    tokens: int
    vocabulary: int
    trans: np.ndarray  # log10 P(class | class before)
    emit: np.ndarray  # of each word sent: log10 P(word | its class)
    end: float  # the same for the end mark
    by_shape: np.ndarray  # of each shape: log10 P(shape | its class) less log10 of its words' mass, for log10(c + ADD)


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the training rows (crc32(doc_id) mod 10 != 0), and the table of all word counts (h, shape, c)."""
    train = docs.filter(crc_mod(F.col("doc_id"), 10) != 0)
    counts = stage(word_counts(train), "counts")
    end = F.lit(int(np.int64(END)))
    per_shape = counts.filter(F.col("h") != end).groupBy("shape").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()  # SHAPES rows
    ends = sum(r[0] for r in counts.filter(F.col("h") == end).select("c").collect())
    total, vocabulary = sum(r["c"] for r in per_shape) + ends, sum(r["v"] for r in per_shape) + (ends > 0)
    top = counts.filter(F.col("h") != end).orderBy(F.desc("c"), "h").limit(SENT_WORDS).toArrow()
    h = top["h"].to_numpy().view(U64)
    order = np.argsort(h)
    h, c, s = h[order], top["c"].to_numpy()[order], top["shape"].to_numpy()[order]
    seed = np.full(len(h), -1)
    best = np.lexsort((h, -c))[:SEED_WORDS]
    seed[best] = np.arange(len(best))
    sent = Sent(h, c, seed, np.zeros(len(h), np.int64), np.zeros(SHAPES, np.int64))
    at = exchange(transitions(train, sent), CLASSES)
    sent.shapes = at[SEED_WORDS + 1 :]
    sent.classes = np.where(seed >= 0, at[np.maximum(seed, 0)], sent.shapes[s])
    pairs = class_pairs(train, sent)
    for _ in range(ROUNDS):
        sent = reassigned(train, sent, pairs)
        pairs = class_pairs(train, sent)
    trans = np.log10((pairs + ADD) / (pairs.sum(1, keepdims=True) + ADD * CLASSES))
    mass, kinds = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in per_shape:
        mass[r["shape"]], kinds[r["shape"]] = r["c"], r["v"]
    np.add.at(mass, s, -c)
    np.add.at(kinds, s, -1)
    # a class holds its words sent, its shapes, and the end mark: each has its count and ADD
    sums = np.bincount(sent.classes, c, CLASSES) + np.bincount(sent.shapes, mass, CLASSES)
    members = np.bincount(sent.classes, minlength=CLASSES) + np.bincount(sent.shapes, minlength=CLASSES)
    sums[sent.end], members[sent.end] = sums[sent.end] + ends, members[sent.end] + 1
    whole = np.log10(sums + ADD * np.maximum(members, 1))
    by_shape = np.log10(mass + ADD) - whole[sent.shapes] - np.log10(mass + ADD * (kinds + 1))
    return Model(sent, int(total), int(vocabulary), trans, np.log10(c + ADD) - whole[sent.classes], float(np.log10(ends + ADD) - whole[sent.end]), by_shape), counts


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of all rows of docs.

    P(text) = product of P(class | class before) P(word | class); of a word that isn't sent, P(word | class) is
    P(shape | class) P(word | shape), the latter (c + ADD) / (tokens of the shape + ADD (its words + 1)), which leaves a
    share for unseen words. Words whose counts weren't sent are joined with the count table. Null texts are empty: one
    end mark; an empty table gives no rows; repeated rows count, and score, each."""
    model, counts = fit(docs)
    bc = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("own", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bc.value
        logs = np.log10(np.append(m.sent.counts, 1) + ADD)
        emit = np.append(m.emit, 0.0)
        for b in batches:
            for i, data, at in slices(b.column(2)):
                h, first, starts, ends = words(data, at)
                shapes = shape(data, starts, ends)
                key, cls = m.sent.places(h, shapes)
                n = len(at) - 1
                doc = np.repeat(np.arange(n), np.diff(first))
                line = np.insert(cls, first, m.sent.end)
                whose = np.insert(doc, first[1:], np.arange(n))  # the document that each step ends in
                known = key >= 0
                own = np.bincount(whose, m.trans[line[:-1], line[1:]], minlength=n) + m.end
                own += np.bincount(doc, np.where(known, emit[key], m.by_shape[shapes]), minlength=n)
                base = np.bincount(doc, np.where(known, logs[key], 0.0), minlength=n)
                rare = np.flatnonzero(~known)
                o = np.lexsort((h[rare], doc[rare]))
                rd, rh = doc[rare][o], h[rare][o]
                new = np.concatenate([[True], (rd[1:] != rd[:-1]) | (rh[1:] != rh[:-1])])[: len(rd)]
                place = np.flatnonzero(new)
                times = np.diff(np.append(place, len(rd))).astype(np.int32)
                off = np.searchsorted(rd[place], np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, n).cast(pa.int64()), b.column(1).slice(i, n), pa.array(np.diff(first) + 1), pa.array(np.bincount(doc, known, minlength=n).astype(np.int64)),
                    pa.array(base), pa.array(own), pa.ListArray.from_arrays(pa.array(off), pa.array(rh[place].view(np.int64))), pa.ListArray.from_arrays(pa.array(off), pa.array(times)),
                ], schema=kind)

    thin = docs.select("doc_id", (crc_mod(F.col("doc_id"), 10) == 0).alias("held_out"), "text")
    rows = stage(thin.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, own double, rare array<long>, times array<int>"), "lines").withColumn("row", F.monotonically_increasing_id())
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("h"), F.col("w.times").alias("t"))
    seen = rare.join(counts.select("h", "c"), "h", "left").groupBy("row").agg(F.sum(F.col("t") * F.log10(F.coalesce("c", F.lit(0)) + ADD)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("t")).otherwise(0)).alias("known"))
    ends = counts.filter(F.col("h") == F.lit(int(np.int64(END)))).agg(F.coalesce(F.max("c"), F.lit(0)).alias("ends"))
    n_ends = ends.collect()[0][0]
    more, floor = F.coalesce("more", F.lit(0.0)), float(np.log10(model.tokens + ADD * (model.vocabulary + 1)))
    return rows.drop("rare", "times").join(seen, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0)) + F.lit(int(n_ends > 0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more + float(np.log10(n_ends + ADD)) - F.col("n_tokens") * floor).alias("base_score"), (F.col("own") + more).alias("score"),
    )
