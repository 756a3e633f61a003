"""Sharding of records by rendezvous hashing over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces a shard is numbered in; each is sorted by itself, so numbering never puts a shard in one task.
SLOT_PIECES = 512


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard i with the largest -w_i / ln(u_i), u_i being the pair's (key, i) hash in (0, 1). A further shard, or
    one with a larger weight, only takes keys into itself; a shard of weight 0 takes none. A null key is one key."""
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must be 0 or more, and one of them over 0")
    u = lambda i: (F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\0null")), F.lit(i)), 11).cast("double") + 0.5) / float(1 << 53)
    scored = [F.struct((F.lit(-float(w)) / F.log(u(i))).alias("s"), F.lit(i).alias("i")) for i, w in enumerate(weights) if w > 0]
    return (F.greatest(*scored) if len(scored) > 1 else scored[0])["i"]


def shard(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """df with `shard` (of the key and weights alone), `slot` (gapless from 0 within a shard) and, for other weights,
    `grown_shard`. All rows of a key fall in one shard. Rows number by a hash of the key in pieces, then key, then
    `order`: two-level, so that a shard with any number of rows is never sorted by one task. Empty in, empty out."""
    k, where = F.col(key), ["__piece", "shard"]
    out = df.withColumn("shard", rendezvous(k, weights).cast("int")).withColumn("grown_shard", rendezvous(k, grown).cast("int") if grown else F.lit(None).cast("int"))
    out = out.withColumn("__piece", F.pmod(F.xxhash64(k, *[F.col(c) for c in order]), F.lit(SLOT_PIECES)).cast("int"))
    sizes = out.groupBy(*where).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")  # SLOT_PIECES rows a shard at most
    inside = Window.partitionBy(*where).orderBy(k.asc_nulls_first(), *order)
    return out.withColumn("__at", F.row_number().over(inside)).join(F.broadcast(starts), where).withColumn("slot", (F.col("__before") + F.col("__at") - 1).cast("long")).drop("__piece", "__at", "__before")


def shard_documents(docs: DataFrame, n: int = 8, weights: Sequence[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of documents over n shards; null text has size 1 and the
    checksum of no bytes. The texts themselves are not moved."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    thin = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    w = list(weights or [1.0] * n)
    out = shard(thin, "doc_id", w, [*w, sum(w) / len(w)], ("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
