"""The registered queries of the training-data operators, and the SQL that checks them where there is such."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import align, ann, brown, dedup, divergence, jaccard, license, packing, quality, shard, simhash, spm
from callweave.llm.common import table


def op1_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return ann.knn(v.filter(F.col("vec_id") % 100 == 0), v, 10)


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_documents(table(spark, sf_dir, "documents"), 8)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encoding_digest(table(spark, sf_dir, "documents"))


def op7_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack_matrices(table(spark, sf_dir, "documents"))
    return rows.select("sequence_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "cu_seqlens", F.crc32("positions").alias("positions_crc32"), "doc_ids", "starts")


def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_documents(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license.scan_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), "n_licenses")


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), stable=True)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_knn, op2_shards, op3_quality, op4_packing, op5_jaccard, op6_sentencepiece, op7_dedup, op8_token_matrices, op9_brown_lm, op10_licenses, op11_align, op12_simhash, op13_divergence)}

ORACLES = {
    "op5_jaccard": r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w),
    flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
    pairs AS (SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 175 * count(*) >= 75 * (a.n + b.n)),
    reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id FROM sets s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = s.doc_id""",
    "op7_dedup": r"""
    WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
    FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op10_licenses": license.oracle(),
    "op13_divergence": r"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
    own AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
    size AS (SELECT lang, count(*) AS v, sum(n) AS whole FROM kept GROUP BY lang),
    seen AS (SELECT DISTINCT lang, source FROM d),
    total AS (SELECT s.lang, s.source, coalesce(sum(o.n), 0) AS total FROM seen s LEFT JOIN own o USING (lang, source) GROUP BY s.lang, s.source),
    grid AS (SELECT k.lang, g.source, k.term, coalesce(o.n, 0) AS n, 1 + (1000000000 * (coalesce(o.n, 0)::HUGEINT + 1)) // (g.total + z.v)::HUGEINT AS p,
            1 + (1000000000 * (k.n::HUGEINT + 1)) // (z.whole + z.v)::HUGEINT AS q
        FROM kept k JOIN total g USING (lang) JOIN size z USING (lang) LEFT JOIN own o ON o.lang = k.lang AND o.source = g.source AND o.term = k.term),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
        FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
    pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value FROM seen a JOIN seen b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
    both_parts AS (SELECT * FROM pair UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM grid WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM both_parts)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
}
