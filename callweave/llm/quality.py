"""Quality scores from text compressed against dictionaries of good and of bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.llm.common import crc_mod

#: The fit's bounded sample: so many labelled documents a class, of at most so many bytes each, the first by a hash.
SAMPLE_DOCS, SAMPLE_BYTES = 1500, 32768
DICTS, DICT_BYTES, PIECE, LEVEL = 6, 32 * 1024, 1024, 3
#: Scores of this much or more predict label 1.
CUT = 0.3


@dataclass(frozen=True)
class Model:
    good: tuple[bytes, ...]
    bad: tuple[bytes, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


def pieces(data: bytes) -> list[bytes]:
    """A text in runs of PIECE bytes, so that the dictionaries, not the text before, explain each."""
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def _alike(x: np.ndarray, k: int) -> np.ndarray:
    """k-means cluster of each row, from centres far apart; no randomness."""
    centres, near = [x[0]], ((x - x[0]) ** 2).sum(1)
    for _ in range(k - 1):
        centres.append(x[near.argmax()])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(15):
        at = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).argmin(1)
        c = np.array([x[at == i].mean(0) if (at == i).any() else c[i] for i in range(k)])
    return at


def dictionaries(samples: list[bytes], seed: int) -> tuple[bytes, ...]:
    """DICTS raw-content dictionaries at most, one for each kind of piece that byte frequencies tell apart (scripts,
    languages, sorts of junk); the pieces in seeded random order, so that each dictionary holds many texts."""
    parts = [p for s in samples for p in pieces(s) if len(p) > 16]
    if not parts:
        return (b" " * 16,)
    bytes_of = np.array([np.bincount(np.frombuffer(p, np.uint8), minlength=256) for p in parts], float)
    at = _alike(np.sqrt(bytes_of / bytes_of.sum(1, keepdims=True)), min(DICTS, len(parts)))
    rng = np.random.default_rng(seed)
    return tuple(b"".join(parts[i] for i in rng.permutation(np.flatnonzero(at == k)))[:DICT_BYTES] for k in np.unique(at))


def _compressor(d: bytes | None = None) -> zstandard.ZstdCompressor:
    extra = {"dict_data": zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if d else {}
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **extra)


class Scorer:
    def __init__(self, m: Model):
        self.good, self.bad, self.plain, self.m = [_compressor(d) for d in m.good], [_compressor(d) for d in m.bad], _compressor(), m

    def sizes(self, text: str | None) -> list[float]:
        """Of a whole text: (size against bad - size against good) / their sum, and the sizes a byte without dictionary
        and against good, each piece by the dictionary of a class that suits it best; the log of the length."""
        data = (text or "").encode()
        parts = pieces(data)
        if not parts:
            return [0.0, 1.0, 1.0, 0.0]
        good = sum(min(len(z.compress(p)) for z in self.good) for p in parts)
        bad = sum(min(len(z.compress(p)) for z in self.bad) for p in parts)
        plain = sum(len(self.plain.compress(p)) for p in parts)
        return [(bad - good) / (bad + good), plain / len(data), good / len(data), float(np.log2(1 + len(data)))]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = design((np.array([self.sizes(t) for t in texts]).reshape(-1, 4) - self.m.mean) / self.m.scale)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.m.weights), -30, 30)))


def design(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -6, 6)
    return np.hstack([np.ones((len(x), 1)), x, *[x[:, [i]] * x[:, [j]] for i in range(x.shape[1]) for j in range(i + 1)]])


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...]]:
    """Means, scales and logistic weights for label 1, by Newton steps with a ridge, the classes weighted equally; then
    the constant is moved so that CUT falls where the error of the calibration rows is least, good text lost counting double."""
    if not len(x) or y.min() == y.max():
        n = design(np.zeros((1, 4))).shape[1]
        return (0.0,) * 4, (1.0,) * 4, ((1.0 if not len(y) or y.max() else -3.0), *[0.0] * (n - 1))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = design((x - mean) / scale)
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.eye(len(w)), a.T @ (weight * (p - y)) + w)
        w -= step
        if abs(step).max() < 1e-8:
            break
    z = a @ w
    cuts = np.unique(z)
    cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    good, bad = np.sort(z[y == 1]), np.sort(z[y == 0])
    error = 2 * np.searchsorted(good, cuts) / len(good) + 1 - np.searchsorted(bad, cuts) / len(bad)
    best = cuts[error <= error.min() + 1e-12]
    w[0] += np.log(CUT / (1 - CUT)) - best[len(best) // 2]
    return tuple(map(float, mean)), tuple(map(float, scale)), tuple(map(float, w))


def sample(docs: DataFrame, labels: DataFrame) -> dict[int, list[bytes]]:
    """Distinct non-blank labelled texts of each class. Labels meet ids, sizes and hashes of texts only; the texts of the
    rows that this picks, 2 x SAMPLE_DOCS x SAMPLE_BYTES at most, are read afterwards, by a broadcast of their ids."""
    lab = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("__y"))
    rows = docs.select("doc_id", "text").filter((crc_mod(F.col("doc_id"), 5) != 0) & (F.octet_length("text") <= SAMPLE_BYTES)).withColumn("__h", F.xxhash64("text"))
    thin = rows.select("doc_id", "__h").join(lab, "doc_id")
    first = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("__h")]
    picked = [r for y in (0, 1) for r in thin.filter(F.col("__y") == y).dropDuplicates(["doc_id", "__h"]).orderBy(*first).limit(SAMPLE_DOCS).collect()]
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["__h"], r["__y"]) for r in picked], "doc_id long, __h long, __y int")
    found = rows.withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(chosen), ["doc_id", "__h"])
    texts = found.groupBy("doc_id", "__h").agg(F.min("text").alias("text"), F.min("__y").alias("__y")).collect()  # a row each of chosen at most
    got: dict[int, list[bytes]] = {0: [], 1: []}
    at = {(r["doc_id"], r["__h"]): k for k, r in enumerate(picked)}
    for r in sorted(texts, key=lambda r: at[r["doc_id"], r["__h"]]):
        got[r["__y"]].append(r["text"].encode())
    return {y: [t for t in dict.fromkeys(s) if t.strip()] for y, s in got.items()}


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Dictionaries and calibration from labelled rows with crc32(doc_id) mod 5 != 0: per class the SAMPLE_DOCS with the
    smallest hashes among texts of SAMPLE_BYTES at most; two thirds build dictionaries, one third calibrates. A label
    given twice counts once, the better one; texts without label, or with another than 0 and 1, take no part."""
    got = sample(docs, labels)
    built = {y: [d for i, d in enumerate(s) if i % 3] for y, s in got.items()}
    m = Model(dictionaries(built[1], 1), dictionaries(built[0], 2), (0.0,) * 4, (1.0,) * 4, ())
    probe = Scorer(m)
    held = [(probe.sizes(d.decode()), y) for y, s in got.items() for d in s[::3]]
    return Model(m.good, m.bad, *calibrate(np.array([x for x, _ in held]).reshape(-1, 4), np.array([y for _, y in held], float)))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a double column: the calibrated score of each whole text; null and empty texts get the score of no
    difference. Other columns pass through unread; one that has the score's name is replaced."""
    docs = docs.select(*[c for c in docs.columns if c != name])
    kind = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s.scores(b.column(at).to_pylist()), pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, kind)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of all rows of docs."""
    thin = docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"))
    out = score(thin, fit(docs, labels))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
