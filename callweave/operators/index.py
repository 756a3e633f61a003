"""A stored retrieval index and what is asked of it: built once, read by every later search."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from callweave.functions import providers
from callweave.functions import text as T
from callweave.operators import search, topk
from callweave.operators.chunk import embedding_text
from callweave.plans.staging import stage

@dataclass(frozen=True)
class Index:
    """chunks (key, title, heading_path, content, ..), rows (key, tokens, counts, length, vector: what a search reads of
    a chunk), terms (token, df, idf), and stats (chunks, average length, terms)."""

    key: str
    chunks: DataFrame
    rows: DataFrame
    terms: DataFrame
    stats: DataFrame


def counted(chunks: DataFrame, key: str, body: Column, vector: Column) -> DataFrame:
    """key, vector, tokens (distinct), counts, length (all words) of every row, in its own row; null texts have none."""
    words = chunks.select(key, vector.cast("array<double>").alias("vector"), T.tokens(body).alias("words"))
    kind = words.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("words")
            length = pc.fill_null(pc.list_value_length(lists), 0)
            coded = lists.flatten().dictionary_encode()
            terms = max(1, len(coded.dictionary))
            row = np.repeat(np.arange(len(lists)), length.to_numpy(zero_copy_only=False))
            pairs, n = np.unique(row * terms + coded.indices.to_numpy(), return_counts=True)
            at = pa.array(np.searchsorted(pairs, np.arange(len(lists) + 1) * terms), pa.int32())
            tokens = coded.dictionary.take(pa.array(pairs % terms)) if len(pairs) else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(at, tokens), pa.ListArray.from_arrays(at, pa.array(n, pa.int32())), pc.cast(length, pa.int32())], names=[key, "vector", "tokens", "counts", "length"])

    return words.mapInArrow(run, S.StructType([S.StructField(key, kind), *S._parse_datatype_string("vector array<double>, tokens array<string>, counts array<int>, length int")]))


def build(chunks: DataFrame, path: str, key: str, text: Column | None = None, vectors: DataFrame | None = None, embed: Callable[[Column], Column] | None = None) -> Index:
    """Writes the index of chunks to path and opens it. Both sides index the title, the heading path and the content, if
    `text` doesn't say otherwise. Vectors are given (key, vector) or made by `embed`; a chunk needs none.

    The corpus is tokenised once, and a chunk's words stay in its row with its vector: what is shuffled are the chunks'
    rows to meet given vectors, and partial document counts of each token."""
    body = embedding_text(F.col("title"), F.col("heading_path"), F.col("content")) if text is None else text
    spark = chunks.sparkSession
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    chunks = spark.read.schema(chunks.schema).parquet(f"{path}/chunks")
    none = F.lit(None).cast("array<double>")
    if vectors is None:
        rows = counted(chunks, key, body, none if embed is None else embed(body))
    else:
        rows = counted(chunks, key, body, none).drop("vector").join(vectors.select(key, F.col("vector").cast("array<double>").alias("vector")), key, "left")
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    n, words, has = rows.agg(F.count(F.lit(1)), F.sum("length"), F.count("vector")).first()
    df = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    df.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).write.mode("overwrite").parquet(f"{path}/terms")
    mean, terms = spark.read.parquet(f"{path}/terms").agg(F.coalesce(F.avg("raw"), F.lit(0.0)), F.count(F.lit(1))).first()
    average = words / n if n and words else 1.0
    spark.createDataFrame([(key, n, float(average), terms, has > 0, float(mean))], "key string, chunks long, average_length double, terms long, has_vectors boolean, mean_raw double").write.mode("overwrite").parquet(f"{path}/stats")
    load.cache_clear()  # what was open may have been written over
    return load(spark, path)


@lru_cache(maxsize=4)
def load(spark: SparkSession, path: str) -> Index:
    """The index at path; the last few stay open."""
    stats = spark.read.parquet(f"{path}/stats")
    s = stats.first()
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    idf = F.when(F.col("raw") < 0, search.EPSILON * F.lit(s["mean_raw"])).otherwise(F.col("raw"))
    return Index(s["key"], read("chunks"), read("rows"), read("terms").select("token", "df", idf.alias("idf")), stats)


def asked(queries: DataFrame, index: Index) -> DataFrame:
    """query_id, tokens, weights, vector of (query_id, query, vector): a token weighs its idf as often as it is asked;
    tokens that no chunk has are left out."""
    words = queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"))
    weighed = words.join(index.terms, "token").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("token", (F.col("times") * F.col("idf")).alias("weight")))).alias("t"))
    got = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).join(weighed, "query_id", "left")
    none = F.coalesce("t", F.array().cast("array<struct<token:string,weight:double>>"))
    return got.select("query_id", F.transform(none, lambda x: x["token"]).alias("tokens"), F.transform(none, lambda x: x["weight"]).alias("weights"), "vector")


def hybrid(queries: DataFrame, index: Index, k: int = 8, category: Column | None = None, fillers: Sequence[str] = (), weights: tuple[float, float] = (0.6, 0.4), matched: bool = False) -> DataFrame:
    """query_id, key, vector_score, bm25_score, score, rank: the k best chunks of each query (query_id, query, vector),
    by unrounded scores. Fillers leave the query first; a category filter of the chunks' columns goes before the
    ranking. A side that a query or a chunk doesn't have (no words, no vector) counts 0, so chunks without a vector are
    found by their words; with `matched` only chunks that share a word are."""
    q = queries.withColumn("query", T.strip_fillers(F.col("query"), fillers)) if fillers else queries
    pool = index.rows if category is None else index.rows.join(index.chunks.filter(category).select(index.key), index.key, "left_semi")
    return topk.top_k(asked(q, index), pool, index.key, k, weights, average=index.stats.first()["average_length"], matched=matched)


def lexical(queries: DataFrame, index: Index, k: int = 8) -> DataFrame:
    """query_id, key, score, rank: the k chunks of the largest saturated BM25 sums that share a word with the query."""
    q = queries.select("query_id", "query", F.lit(None).cast("array<double>").alias("vector"))
    return hybrid(q, index, k, weights=(0.0, 1.0), matched=True).select("query_id", index.key, "score", "rank")


def cross_lingual(queries: DataFrame, index: Index, answer_language: str, corpus_language: str, translate: Callable[[Column], Column], embed: Callable[[Column], Column], k: int = 8) -> DataFrame:
    """hybrid() of each query and, if its answers' language isn't the corpus', of its translation, the best of both."""
    own = queries.withColumn("vector", embed(F.col("query")))
    first = hybrid(own, index, k)
    if not queries.sparkSession.range(1).select(search.cross_lingual(F.lit(answer_language), F.lit(corpus_language))).first()[0]:
        return first.select("query_id", index.key, "score", F.lit(0).alias("variant"), "rank")
    other = queries.withColumn("query", translate(F.col("query"))).withColumn("vector", embed(F.col("query")))
    return search.merge_variants([first, hybrid(other, index, k)], index.key, k)


def answer(queries: DataFrame, ranked: DataFrame, index: Index, model: Callable[[Column], Column], refusal: str, authored: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """query_id, text, refused, gate, citations, invalid, grounded, retrieved: the model's answer from the ranked chunks.
    A query below `least` is refused before the model is asked, unless authored passages (query_id, passage) exist for
    it; one whose answer holds the refusal token after it. Only citations of retrieved chunks count; an answer is
    grounded if it rests on any passage."""
    key, ranked = index.key, stage(ranked)  # searched once, read three times
    text = ranked.join(index.chunks.select(key, "content"), key)
    context = search.context_block(text, key, "content")
    ids = ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(key).cast("string").alias("k")))), lambda x: x["k"]).alias("retrieved"))
    own = authored.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("passage")), "\n\n").alias("authored")) if authored is not None else None
    q = queries.join(search.gate(ranked, least), "query_id", "left").join(context, "query_id", "left").join(ids, "query_id", "left")
    q = q.join(own, "query_id", "left") if own is not None else q.withColumn("authored", F.lit(""))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    a = providers.gated_answer(F.col("query"), blank("context"), F.coalesce("answerable", F.lit(False)), blank("authored"), model, refusal)
    got = q.withColumn("a", a).withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<string>")))
    valid, invalid = search.validate_citations(T.citations(F.col("a.text")), F.col("retrieved"))
    grounded = ~F.col("a.refused") & ((F.size("retrieved") > 0) | (blank("authored") != ""))
    return got.select("query_id", T.strip_citations(F.col("a.text")).alias("text"), "a.refused", "a.gate", valid.alias("citations"), invalid.alias("invalid"), grounded.alias("grounded"), "retrieved")
