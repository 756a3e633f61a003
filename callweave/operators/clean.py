"""Cleaning: boilerplate lines, validation, drops with an audit, near-duplicates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from callweave.functions import text as T
from callweave.plans.staging import stage


def boilerplate(pages: DataFrame, key: str, body: str, ratio: float = 0.25, max_words: int = 25, least: int = 2) -> DataFrame:
    """line, pages: lines on at least max(least, ratio of all pages) pages, of max_words at most, headings left out.
    Lines are counted once a page with partial aggregation, so a line on every page never meets in one task."""
    line = F.explode(F.array_distinct(F.transform(F.split(body, "\n"), T.strip)))
    lines = pages.select(line.alias("line")).filter((F.col("line") != "") & ~F.col("line").rlike(r"^#{1,4}\s+\S") & (T.word_count(F.col("line")) <= max_words))
    floor = pages.agg(F.greatest(F.lit(least), F.floor(F.count(F.lit(1)) * ratio)).alias("floor"))
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("pages")).join(F.broadcast(floor), F.col("pages") >= F.col("floor")).select("line", "pages")


def strip_boilerplate(pages: DataFrame, key: str, body: str, lines: DataFrame) -> DataFrame:
    """key, body, removed: bodies without the boilerplate lines. Lines are numbered, those of the set struck out by an
    anti-join, which Spark broadcasts while the set is small, and the rest put together again."""
    each = pages.select(key, F.posexplode(F.split(body, "\n")).alias("pos", "l")).withColumn("line", T.strip(F.col("l")))
    kept = each.join(lines.select("line"), "line", "left_anti").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "l"))), lambda x: x["l"]), "\n").alias("body"), F.count(F.lit(1)).alias("__n"))
    return pages.select(key, F.size(F.split(body, "\n")).alias("__all")).join(kept, key, "left").select(key, F.coalesce("body", F.lit("")).alias("body"), (F.col("__all") - F.coalesce("__n", F.lit(0))).cast("int").alias("removed"))


def warnings(content: Column, title: Column, min_words: int = 40) -> Column:
    """array<string> of what is wrong with a record. Its words and the patterns behind them are fixed values."""
    lines = F.filter(F.split(content, "\n"), lambda x: T.strip(x) != "")
    n = T.word_count(content)
    return F.array_compact(F.array(
        F.when(n < min_words, F.concat(F.lit("thin content ("), n.cast("string"), F.lit(" words)"))), F.when(F.coalesce(title, F.lit("")) == "", F.lit("missing title")),
        F.when(content.rlike("(?i)lorem ipsum|test page|coming soon"), F.lit("placeholder text detected")), F.when(content.contains("�"), F.lit("encoding errors present")),
        F.when((F.size(lines) > 0) & (F.size(F.array_distinct(lines)) / F.size(lines) < 0.4), F.lit("highly repetitive content, extraction may have failed")),
    ))


def funnel(records: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """step, reason, dropped, remaining: each record falls at the first reason that holds; counted in one pass."""
    first = F.coalesce(*[F.when(c, F.lit(i)) for i, (_, c) in enumerate(reasons)], F.lit(len(reasons)))
    got = records.groupBy(first.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    names = records.sparkSession.createDataFrame([(i, r) for i, (r, _) in enumerate(reasons)], "step int, reason string")
    total = got.agg(F.sum("n").alias("total"))
    joined = names.join(got, "step", "left").withColumn("dropped", F.coalesce("n", F.lit(0))).crossJoin(F.broadcast(total))
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as reasons
    return joined.select("step", "reason", "dropped", (F.col("total") - F.sum("dropped").over(w)).alias("remaining"))


def _majority(sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The bits set in more than half of each row's hashes: one pass over all bits of some rows."""
    ends = np.cumsum(sizes)
    out = np.zeros(len(sizes), np.int64)
    for rows in np.array_split(np.arange(len(sizes)), max(1, len(hashes) // 500_000)):
        if len(rows):
            first = ends[rows[0]] - sizes[rows[0]]
            bits = np.unpackbits(hashes[first : ends[rows[-1]]].astype(">i8").view(np.uint8)).reshape(-1, 64)
            total = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(bits, 0, dtype=np.int64)])
            stop = ends[rows] - first
            ones = 2 * (total[stop] - total[stop - sizes[rows]]) > sizes[rows][:, None]
            out[rows] = np.packbits(ones, axis=1).view(">i8").ravel()
    return out


#: Digests of which a shingle's hash is the first 8 bytes, big-endian.
DIGESTS = {"md5": lambda x: hashlib.md5(x, usedforsecurity=False).digest()[:8], "blake2b": lambda x: hashlib.blake2b(x, digest_size=8).digest()}


def simhash(docs: DataFrame, key: str, text: str, k: int = 4, digest: str = "md5") -> DataFrame:
    """key, fingerprint: the bits set in more than half of the hashes of a text's k-token shingles; fewer tokens count
    each, none as `_empty_`. Rows keep to themselves: nothing is exploded or shuffled. A row with null text has no
    fingerprint and is left out."""
    rows = docs.filter(F.col(text).isNotNull()).select(key, T.word_tokens(F.col(text)).alias("w"))

    def hashes(tokens: list[str]) -> list[bytes]:
        short = DIGESTS[digest]
        words = [w.encode() for w in tokens] or [b"_empty_"]
        if len(words) < k:
            return [short(w) for w in words]
        line, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        return [short(line[a : b - 1]) for a, b in zip(starts, ends[k - 1 :], strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                each = [hashes(w) for w in b.column(1).to_pylist()]
                flat = np.frombuffer(b"".join(map(b"".join, each)), ">i8")
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_majority(np.array([len(h) for h in each]), flat))], names=[key, "fingerprint"])

    return rows.mapInArrow(run, StructType([rows.schema[key], StructField("fingerprint", LongType())]))


@F.pandas_udf(LongType())
def blake64(s: pd.Series) -> pd.Series:
    """First 8 bytes of an 8-byte BLAKE2b digest, big-endian, as a signed long."""
    return s.map(lambda x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big", signed=True), na_action="ignore").astype("Int64")


def near_pairs(prints: DataFrame, key: str, distance: int = 4) -> DataFrame:
    """x, y, distance (x < y): fingerprints at most `distance` bits apart. Equal ones collapse to their smallest key
    first. Of distance + 2 blocks of bits such a pair has two blocks in common at least: keys of two blocks each, so few
    others meet, and a pair is told by its first two common blocks alone."""
    one = prints.groupBy("fingerprint").agg(F.min(key).alias("k"))
    n = distance + 2
    cuts = [round(i * 64 / n) for i in range(n + 1)]
    mask = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(n)]
    lit = lambda m: F.lit(m - (1 << 64) if m >> 63 else m)
    combos = [(i, j) for i in range(n) for j in range(i + 1, n)]
    keys = F.array(*[F.col("fingerprint").bitwiseAND(lit(mask[i] | mask[j])) for i, j in combos])
    bands = one.select("k", "fingerprint", F.posexplode(keys).alias("band", "v"))
    a, b = bands.select("band", "v", F.col("k").alias("x"), F.col("fingerprint").alias("fx")), bands.select("band", "v", F.col("k").alias("y"), F.col("fingerprint").alias("fy"))
    apart = F.col("fx").bitwiseXOR(F.col("fy"))
    same = [apart.bitwiseAND(lit(m)) == 0 for m in mask]
    none = F.lit(True)
    first = none
    for c, (i, j) in reversed(list(enumerate(combos))):
        earlier = [~same[x] for x in range(j) if x != i]
        first = F.when(F.col("band") == c, reduce(and_, earlier, none)).otherwise(first)
    d = F.bit_count(apart)
    return a.join(b, ["band", "v"]).filter((F.col("x") < F.col("y")) & (d <= distance) & first).select("x", "y", d.cast("int").alias("distance"))


def near_groups(prints: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """key, representative (the smallest key with the same fingerprint), links: how many other fingerprints are near."""
    rep = prints.groupBy("fingerprint").agg(F.min(key).alias("representative"))
    ends = pairs.select(F.col("x").alias("representative")).unionByName(pairs.select(F.col("y").alias("representative")))
    links = ends.groupBy("representative").agg(F.count(F.lit(1)).alias("links"))
    return prints.join(rep.join(links, "representative", "left"), "fingerprint").select(key, "representative", F.coalesce("links", F.lit(0)).alias("links"))


def greedy_survivors(records: DataFrame, key: str, words: str, pairs: DataFrame, distance: int = 4) -> DataFrame:
    """key, kept, duplicate_of: longest first (ties by key), a record is dropped if an earlier kept one is near it.
    Rounds over the pair graph: what has no earlier undecided or kept neighbour is kept, what has a kept one is dropped.
    records also has `fingerprint`; those equal to an earlier one fall at once."""
    order = F.struct((-F.col(words)).alias("w"), F.col(key).alias("k"))
    ranked = records.withColumn("__o", order)
    ranked = stage(ranked)
    ranked = stage(ranked.join(ranked.groupBy("fingerprint").agg(F.min("__o").alias("__first")), "fingerprint"))  # a copied text's rows may be split
    reps = ranked.filter("__o = __first").select(F.col(key).alias("__id"), F.col("__o").alias("o"), "fingerprint")
    both = stage(near_pairs(reps.withColumnRenamed("__id", key), key, distance)) if pairs is None else pairs
    named = both.join(reps.select(F.col("__id").alias("x"), F.col("o").alias("ox")), "x").join(reps.select(F.col("__id").alias("y"), F.col("o").alias("oy")), "y")
    edges = stage(named.select(F.when(F.col("ox") < F.col("oy"), F.col("x")).otherwise(F.col("y")).alias("early"), F.when(F.col("ox") < F.col("oy"), F.col("y")).otherwise(F.col("x")).alias("late")))
    state = stage(reps.join(edges.select(F.col("late").alias("__id")).distinct(), "__id", "left_anti").select("__id", F.lit(True).alias("kept")))
    while True:
        left = edges.join(state.select(F.col("__id").alias("late")), "late", "left_anti").join(state.select(F.col("__id").alias("early"), "kept"), "early", "left")
        new = left.groupBy("late").agg(F.bool_or(F.coalesce("kept", F.lit(False))).alias("hit"), F.bool_and(F.col("kept").isNotNull()).alias("known")).filter("hit or known").select(F.col("late").alias("__id"), (~F.col("hit")).alias("kept"))
        new = stage(new)
        if not new.limit(1).count():
            break
        state = stage(state.unionByName(new))
    kept_edges = edges.join(state.filter("kept").select(F.col("__id").alias("early")), "early").join(reps.select(F.col("__id").alias("early"), "o"), "early")
    origin = kept_edges.groupBy("late").agg(F.min_by("early", "o").alias("of")).select(F.col("late").alias("__id"), "of")
    fate = state.join(origin, "__id", "left").select("__id", "kept", F.when(~F.col("kept"), F.col("of")).alias("of"))
    rows = ranked.select(key, F.col("__first.k").alias("__id")).join(fate, "__id")
    own = F.col(key) == F.col("__id")
    return rows.select(key, (own & F.col("kept")).alias("kept"), F.when(own, F.col("of")).otherwise(F.coalesce("of", "__id")).alias("duplicate_of"))


def record_ids(records: DataFrame, category: str, order: str) -> DataFrame:
    """records with record_id (`kb_category_001`, numbered over all records in order, from 1) and source, the category in
    words. Numbers are a count of the rows of the partitions before and a place in the own one, after a range sort: no
    window holds all rows."""
    spark = records.sparkSession
    dealt = records.repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id())
    dealt = stage(dealt)
    part = F.shiftright("__at", 33)
    sizes = dealt.groupBy(part.alias("__part")).agg(F.max("__at").alias("last"), F.count(F.lit(1)).alias("n")).collect()  # a row a partition
    before, rows = 0, []
    for r in sorted(sizes, key=lambda r: r["__part"]):
        rows.append((r["__part"], before))
        before += r["n"]
    starts = spark.createDataFrame(rows, "__part long, __before long")
    number = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    out = dealt.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn("record_id", F.format_string("kb_%s_%03d", F.col(category), number))
    return out.withColumn("source", F.concat(F.replace(F.col(category), F.lit("_"), F.lit(" ")), F.lit(" / website section"))).drop("__part", "__before", "__at")
