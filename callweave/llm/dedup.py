"""Exact deduplication by content-defined chunk recipes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import attach, mix, stage

#: Chunk sizes in bytes: none is cut before MIN, all are by MAX, and a cut falls after 2**CUT_BITS more on average.
MIN_CHUNK, MAX_CHUNK, CUT_BITS = 1024, 16384, 12
WINDOW = 16
_RUN = re.compile(r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]")
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
SCHEMA = "doc_id long, text_sha256 string, n_bytes long, recipe binary, chunks array<struct<id:binary,size:int,sha:binary>>"


def normalise(text: str) -> str:
    """Each run of ASCII white space as one blank."""
    return _RUN.sub(" ", text)


def cuts(data: bytes) -> list[int]:
    """Past-last bytes of the chunks of data: where the rolling hash of the last WINDOW bytes ends in CUT_BITS zeros,
    so an edit moves the cuts near it alone. Depends on data only."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    w = 1
    while w < WINDOW:  # hash of 2w bytes = hash of the last w + (hash of the w before, shifted)
        h[w:] = h[w:] + (h[:-w].copy() << np.uint32(w))
        w *= 2
    marks = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1
    out, at = [], 0
    while n - at > MIN_CHUNK:
        i = int(np.searchsorted(marks, at + MIN_CHUNK))
        end = min(int(marks[i]) if i < len(marks) else n, at + MAX_CHUNK, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("n_bytes", pa.int64()), ("recipe", pa.binary()), ("chunks", pa.list_(pa.struct([("id", pa.binary()), ("size", pa.int32()), ("sha", pa.binary())])))])
    seen: set[bytes] = set()
    for b in batches:
        rows = []
        for doc_id, text in zip(b.column(0), b.column(1), strict=True):
            data = normalise(text.as_py() or "").encode()
            parts, ids, at = [], [], 0
            for end in cuts(data):
                sha = hashlib.sha256(data[at:end]).digest()
                ids.append(sha[:12])
                if sha not in seen:  # once a task: the store keeps one copy of a chunk's identity
                    if len(seen) < 200_000:
                        seen.add(sha)
                    parts.append({"id": sha[:12], "size": end - at, "sha": sha})
                at = end
            rows.append((doc_id.as_py(), hashlib.sha256(data).hexdigest(), len(data), b"".join(ids), parts))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kind.types, strict=True)], schema=kind)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (columns doc_id, text).

    Texts are cut into content-defined chunks where they lie and never moved: a chunk's identifier is 12 bytes of its
    SHA-256, a recipe is a text's ordered list of identifiers, and texts with one recipe are equal. Identifiers are
    verified in the chunk store (one row an identifier): one that stood for two different chunks ends the job
    rather than merge texts wrongly. Null and empty texts are equal; of rows repeating the smallest doc_id of a group
    each counts and one of them stays; a null doc_id is the largest."""
    done = stage(docs.select("doc_id", "text").mapInArrow(_recipes, SCHEMA), "recipes")
    store = done.select(F.explode("chunks").alias("c")).groupBy("c.id").agg(F.min("c.sha").alias("lo"), F.max("c.sha").alias("hi"), F.min("c.size").alias("small"), F.max("c.size").alias("large"))
    clash = store.filter((F.col("lo") != F.col("hi")) | (F.col("small") != F.col("large"))).limit(1).count()
    if clash:
        raise RuntimeError("two chunks share an identifier")
    rows = done.select("doc_id", "text_sha256", F.sha2("recipe", 256).alias("recipe"), F.monotonically_increasing_id().alias("row"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    groups = rows.groupBy("recipe").agg(first, F.count(F.lit(1)).alias("group_size"))
    out = attach(rows, groups, "recipe", "group_size", done.count())
    return out.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")
