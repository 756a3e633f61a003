"""Alignment of two tokenizers' tokens by the bytes that they cover, as joins and windows over exploded tokens."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm import common, spm, tokens

#: Bytes of text whose distinct pieces are looked up together.
BLOCK_BYTES = 32 << 20
#: Bytes of text of the pieces that a block's documents are put together from at once.
SLICE_BYTES = 1 << 20
#: Distinct pieces that a task aligns.
PART_UNITS = 50_000
#: Rows that a partition numbers before the partition's own number begins.
_PART = 33
#: A place where a text can be cut: before a single blank between two characters that are neither blank nor odd. No
#: token of either tokenizer spans it.
_CUT = r"(?= [^\p{Z}\p{C}\s])(?<=[^\p{Z}\p{C}\s])"
#: What stands for a blank in the second tokenizer, so that a text that holds it can't be told apart from one with blanks.
MARK = spm.SPACE


def stage(df: DataFrame, name: str) -> DataFrame:
    return common.stage(df, name, compression="zstd")


def pieces(text: Column) -> Column:
    """The pieces of a blank and the text; each begins with a blank, and joined they are that text again."""
    return F.split(F.concat(F.lit(" "), text), _CUT, -1)


def encoded(units: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """All columns of units with tokens, those of side A before those of side B, each as one number (see `_packed`), and
    `whole`: are both sides' bytes those of the unit."""
    path_a, path_b = path_a or tokens.default_path(), path_b or spm.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        first, second = tokens.encoder(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        raw_a = {i: first.bpe.decode_single_token_bytes(i) for i in first.bpe._mergeable_ranks.values()}
        raw_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace(MARK, " ").encode() for i, p in ((i, second.id_to_piece(i)) for i in range(second.get_piece_size()))]
        size_a = np.zeros(max(raw_a) + 1, np.int32)
        size_a[list(raw_a)] = [len(x) for x in raw_a.values()]
        size_b = np.array([len(x) for x in raw_b], np.int32)
        encode_a = first.bpe._core_bpe.encode_ordinary

        for b in batches:
            texts = b.column("unit").to_pylist()
            raw = [t.encode() for t in texts]
            ids_a, ids_b = list(map(encode_a, texts)), second.encode([t[1:] for t in texts], num_threads=1)
            same, sides, counts = np.ones(len(texts), bool), [], []
            for side, ids, each, size in ((0, ids_a, raw_a.__getitem__, size_a), (1, ids_b, raw_b.__getitem__, size_b)):
                flat = np.fromiter(chain.from_iterable(ids), np.int64)
                counts.append(np.fromiter(map(len, ids), np.int64, len(ids)))
                at = np.concatenate([[0], np.cumsum(counts[-1])])
                same &= np.diff(np.concatenate([[0], np.cumsum(size[flat])])[at]) == np.fromiter(map(len, raw), np.int64, len(raw))
                if b"".join(map(each, flat.tolist())) != b"".join(raw):
                    same &= np.fromiter((b"".join(map(each, i)) == r for i, r in zip(ids, raw, strict=True)), bool, len(raw))
                sides.append(_packed(side, flat, size[flat]))
            unit = np.concatenate([np.repeat(np.arange(len(texts)), n) for n in counts])
            both = np.concatenate(sides)[np.argsort(unit, kind="stable")]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sum(counts))]), pa.int32()), pa.array(both))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(same)], names=[*b.schema.names, "tokens", "whole"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.schema)
    return units.mapInArrow(run, f"{kind}, tokens array<int>, whole boolean")


def _packed(side: int, number: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Tokens as one number each: the side (0 or 1), 18 bits of the id, 12 bits of how many bytes it stands for."""
    if len(number) and (number.max() >= 1 << 18 or size.max() >= 1 << 12):
        raise ValueError("ids of 18 bits and tokens of under 4,096 bytes only")
    return ((side << 30) | (number << 12) | size).astype(np.int32)


def aligned(units: DataFrame, parts: int) -> DataFrame:
    """unit, n, n_a, n_b, n_groups, links (array of (a, b)), groups (as text) of each row of units (uid, unit, n,
    tokens).

    Both sides' tokens are exploded with their places, and running sums of their bytes are where they end. Joined on the
    unit and the end (both sides' rows meet in one grouping, there being one of each side at most), the places where both
    end are the links; the number of such places before a token is its group. Rows are dealt by `uid` once, for the
    windows, the join and the sums alike."""
    dealt = lambda *c: units.select(F.pmod("uid", F.lit(parts)).cast("int").alias("deal"), "uid", *c).repartitionById(parts, F.col("deal"))
    own = ["deal", "uid"]
    bits = lambda at, n: F.shiftright("t", at).bitwiseAND((1 << n) - 1)
    each = dealt("tokens").select(*own, F.posexplode_outer("tokens").alias("place", "t"))
    each = each.select(*own, "place", bits(30, 1).alias("side"), bits(12, 18).alias("id"), bits(0, 12).alias("size"))
    ends = each.withColumn("end", F.sum("size").over(Window.partitionBy(*own, "side").orderBy("place")))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("id")))
    merged = ends.groupBy(*own, "end").agg(of(0).alias("a"), of(1).alias("b"))
    cut = F.col("a").isNotNull() & F.col("b").isNotNull()
    before = Window.partitionBy(*own).orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    grouped = merged.withColumn("cut", cut.cast("int")).withColumn("group", F.coalesce(F.sum("cut").over(before), F.lit(0)))
    ids = lambda side: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(side).isNotNull(), F.struct("end", side)))), lambda x: x[side].cast("string")), ",")
    link = F.max(F.when(F.col("cut") == 1, F.struct("a", "b"))).alias("link")
    by_group = grouped.groupBy(*own, "group").agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), link, F.concat(ids("a"), F.lit("|"), ids("b")).alias("text"))
    groups = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("group", "text"))), lambda x: x["text"]), ";")
    by_unit = by_group.groupBy(*own).agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.count("link").alias("n_groups"), F.collect_list("link").alias("links"), groups.alias("groups"))
    return by_unit.join(dealt("unit", "n").hint("shuffle_hash"), own).drop(*own)


def pair_counts(units: DataFrame) -> DataFrame:
    """a, b, count, best: how often each pair of ids is linked in the corpus, and whether that is the most for its b;
    units has (n, links), n being how often the unit occurs."""
    counts = stage(units.select("n", F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.sum("n").alias("count")), "pair-counts")
    return counts.join(counts.groupBy("b").agg(F.max("count").alias("most")), "b").select("a", "b", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _told(docs: pa.Table, table: pa.Table) -> pa.Table:
    """The rows of a block's documents (doc_id, units), from what each of its pieces gives. A batch's pieces are looked
    up all at once where they lie, and put together in slices of about SLICE_BYTES of their text, so that little is held
    beside the block; a document has one piece at least, and may lie in several slices."""
    unit, groups = table.column("unit").combine_chunks(), table.column("groups").cast(pa.binary()).combine_chunks()
    values = [table.column(c).combine_chunks().to_numpy() for c in ("n_a", "n_b", "n_groups", "n_best", "count_sum")]
    sums, digests = [[np.zeros(0, np.int64)] for _ in values], []
    for units in docs.column("units").chunks:
        flat = units.flatten()
        edge = np.concatenate([[0], np.cumsum(pc.list_value_length(units).to_numpy())])
        end = np.frombuffer(flat.buffers()[1], np.int64 if pa.types.is_large_string(flat.type) else np.int32)[flat.offset + 1 : flat.offset + len(flat) + 1] if len(flat) else np.zeros(0, np.int64)
        at, i = pc.index_in(flat, value_set=unit), 0
        pa.default_memory_pool().release_unused()
        for s in sums:
            s.append(np.zeros(len(units), np.int64))
        while i < len(flat):
            j = max(i + 1, int(np.searchsorted(end, int(end[i]) + SLICE_BYTES, "right")))
            some = at.slice(i, j - i)
            d, e = int(np.searchsorted(edge, i, "right")) - 1, int(np.searchsorted(edge, j))
            first, own = np.maximum(edge[d:e] - i, 0), some.to_numpy()
            for s, value in zip(sums, values, strict=True):
                s[-1][d:e] += np.add.reduceat(value[own], first)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, j - i), pa.int32()), groups.take(some)), b";")
            for k, text in enumerate(joined.to_pylist(), d):
                if edge[k] < i:
                    digest.update(b";" + text)
                else:
                    digest = hashlib.sha256(text)
                if edge[k + 1] <= j:
                    digests.append(digest.hexdigest())
            i = j
    got = [pa.array(np.concatenate(s), pa.int64()) for s in sums]
    return pa.Table.from_arrays([docs.column("doc_id"), *[got[k] for k in (0, 1, 2, 2, 3, 4)], pa.array(digests, pa.string())], names=[c.split()[0] for c in _OUT.split(", ")])


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, stable: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row: the alignment of a blank and
    the text by a byte-level BPE file (A) with the text by a SentencePiece file that puts a blank before it (B).

    Neither tokenizer's tokens span a single blank between two words, so the pieces between such blanks are aligned once
    each, however often they occur, weighed by their number for the corpus-wide counts, and put together again to
    documents. Documents go in blocks of about BLOCK_BYTES: a block's distinct pieces are counted where it is read, and
    meet the block again as a table of what each piece gives, so that no exploded piece is moved. docs is read twice; if
    it may then come in another order (as from a shuffle; files don't), it must not be called `stable`, and is written
    down first.

    Null, empty and unalignable texts (those that hold U+2581, or that either side's bytes don't give back) have zeros
    and an empty digest, and add to no count. Each row has its own, so null and repeated doc_ids and repeated texts do
    no harm; other columns don't matter."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = (rows if stable else stage(rows, "rows")).withColumn("row", F.monotonically_increasing_id())
    part, place = F.shiftright("row", _PART), F.col("row").bitwiseAND((1 << _PART) - 1)
    sizes = rows.groupBy(part.alias("part")).agg(F.max(place).alias("last"), F.sum(F.octet_length("text")).alias("bytes"))
    last_part, last, most = sizes.agg(F.max("part"), F.max("last"), F.max("bytes")).first()
    each = -(-(most or 0) // BLOCK_BYTES) or 1  # blocks of a partition
    run, blocks = -(-((last or 0) + 1) // each), ((last_part or 0) + 1) * each
    block = (part * each + F.floor(place / run)).cast("int").alias("block")
    can = F.coalesce((F.col("text") != "") & (F.instr("text", MARK) == 0), F.lit(False))
    fit, rest = rows.filter(can).select(block, "row", "doc_id", "text"), rows.filter(~can).select("doc_id")
    while True:
        exploded = fit.select("block", F.explode_outer(pieces(F.col("text"))).alias("unit"))
        vocabulary = stage(exploded.groupBy("block", "unit").agg(F.count(F.lit(1)).alias("n")), "vocabulary")
        distinct = vocabulary.groupBy("unit").agg(F.sum("n").alias("n")).select(F.monotonically_increasing_id().alias("uid"), "unit", "n")
        units = stage(encoded(distinct, path_a, path_b), "units")
        broken = units.filter("NOT whole").select("unit")
        if broken.isEmpty():
            break
        # such texts take no part in the counts, so they go before the counts are made again
        odd = stage(fit.select("row", "doc_id", F.explode_outer(pieces(F.col("text"))).alias("unit")).join(broken, "unit", "left_semi").select("row", "doc_id").distinct(), "odd")
        fit, rest = stage(fit.join(odd, "row", "left_anti"), "fit"), rest.unionByName(odd.select("doc_id"))

    found = stage(aligned(units, -(-units.count() // PART_UNITS) or 1), "aligned")
    linked = found.select("unit", F.explode("links").alias("l")).select("unit", "l.a", "l.b").join(pair_counts(found), ["a", "b"])
    sums = linked.groupBy("unit").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    gives = found.drop("n", "links").join(sums, "unit")
    table = stage(vocabulary.select("block", "unit").join(gives, "unit"), "table").repartitionById(blocks, F.col("block"))
    common.forget(vocabulary, units, found)  # all that is still read of them is in the table
    told = fit.select("block", "doc_id", "text").repartitionById(blocks, F.col("block")).select("block", "doc_id", pieces(F.col("text")).alias("units"))
    out = told.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(_told, _OUT)
    names = [c.split()[0] for c in _OUT.split(", ")]
    return out.unionByName(rest.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in names[1:-1]], F.lit("").alias(names[-1])))
