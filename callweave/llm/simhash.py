"""Near duplicates by SimHash: fingerprints of word shingles, candidates by pigeonring chains of segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import attach, stage
from callweave.llm.graph import components

#: Words of a shingle, and the seed of its hash.
WORDS, SEED = 3, 42
#: Fingerprints link if so many bits differ at most.
DISTANCE = 2
#: Segments of the ring.
SEGMENTS = 7
#: Fingerprints of one key that are compared in pairs; more are linked by the points between them.
CROWD = 64
#: Shingles whose bits are summed at once.
SUMMED = 1 << 16


def fingerprint(text: str | None) -> int:
    """The SimHash of a text as a signed 64-bit integer; 0 if it has no words."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z alone, and blanks \x20 and \x09-\x0D alone
    if not words:
        return 0
    line, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = (end - size + 1).tolist()
    end = end.tolist()
    k = min(WORDS, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(start[: len(words) - k + 1], end[k - 1 :], strict=True)), np.uint64, len(words) - k + 1)
    ones = sum(np.unpackbits(h[i : i + SUMMED].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, len(h), SUMMED))
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long) of every row; nothing is shuffled."""
    kind = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.int64())], schema=kind)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def masks(length: int) -> list[int]:
    """The bits of the chain of `length` segments that starts at each segment of the ring, as signed integers."""
    cut = [64 * i // SEGMENTS for i in range(SEGMENTS + 1)]
    segment = [(1 << cut[i + 1]) - (1 << cut[i]) for i in range(SEGMENTS)]
    out = [sum(segment[(i + j) % SEGMENTS] for j in range(length)) for i in range(SEGMENTS)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def budget(length: int) -> int:
    """Bits that may differ over the first `length` segments of a viable chain."""
    return length * DISTANCE // SEGMENTS


#: Segments at the start of a viable chain in which nothing may differ.
EQUAL = max(n for n in range(1, SEGMENTS + 1) if budget(n) == 0)


def _of_chain(length: int) -> Column:
    return F.element_at(F.array(*[F.lit(m).cast("long") for m in masks(length)]), F.col("chain") + 1)


def links(prints: DataFrame) -> DataFrame:
    """a, b: edges that join the fingerprints (distinct, column fp) just as links of DISTANCE or fewer differing bits do.

    Of two such fingerprints, some chain of segments around the ring never differs in more than its share of the bits:
    in none of its first EQUAL segments, in budget(n) of its first n. So fingerprints meet by each chain's first EQUAL
    segments, pairs must hold the budget at each further segment, and those left are compared whole. A key that more
    than CROWD fingerprints share makes no pairs: there every fingerprint names the points one bit beside it, outside
    the key, and all that name one point are joined to the smallest of them; two fingerprints of a key are two bits
    apart at most just when they name a point in common. So rows grow in proportion to the fingerprints."""
    keys = prints.select("fp", F.explode(F.array(*[F.lit(i) for i in range(SEGMENTS)])).alias("chain")).withColumn("key", F.col("fp").bitwiseAND(_of_chain(EQUAL)))
    sizes = keys.groupBy("chain", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = stage(keys.join(sizes, ["chain", "key"]), "chains")
    few = met.filter(F.col("n") <= CROWD).select("chain", "key", "fp")
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["chain", "key"]).filter("a < b")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    for n in range(EQUAL + 1, SEGMENTS):
        pairs = pairs.filter(F.bit_count(apart.bitwiseAND(_of_chain(n))) <= budget(n))
    pairs = pairs.filter(F.bit_count(apart) <= DISTANCE).select("a", "b")

    outside = F.bitwise_not(_of_chain(EQUAL))
    crowd = met.filter(F.col("n") > CROWD).groupBy("fp").agg(F.bit_or(outside).alias("free"))
    bits = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    named = crowd.select("fp", F.explode(F.filter(bits, lambda x: x.bitwiseAND(F.col("free")) == x)).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("point"))
    least = named.groupBy("point").agg(F.min("fp").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("point", "first")
    stars = named.join(least, "point").filter("fp <> first").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable over links, its own
    included) of every row.

    A text is lower-cased (A-Z), cut into words `[^\\x20\\x09-\\x0D]+` and hashed by 3-word shingles, repeats included;
    fewer words are one shingle, and null or blank texts have fingerprint 0, which links as any other. Equal fingerprints
    count once in the search, so copies, however many, cost nothing there. A null doc_id is the largest: a component
    without any other has null. Rows stay as many as they are; other columns don't matter."""
    rows = stage(fingerprints(docs), "fingerprints")
    prints = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "prints")
    labels = components(links(prints.select("fp"))).withColumnsRenamed({"node": "fp"})
    named = prints.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    groups = stage(named.join(smallest, "label").select("fp", "component_id", "copies"), "groups")
    out = attach(rows, groups, "fp", "copies", prints.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
