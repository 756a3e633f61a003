"""The registered queries of the library's own operators, each beside the DuckDB SQL that checks it where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.functions import providers, tables
from callweave.functions import text as T
from callweave.operators import calls, chunk, clean, extract, index, pages, reports, search, signals, topk
from callweave.plans.staging import listing, shared_dir, stage
from callweave.sources import web

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def values(spark: SparkSession, sql: str) -> DataFrame:
    """An inline table that both engines read alike."""
    return spark.sql(f"SELECT * FROM {sql}")


ASKED = "(SELECT item_id AS query_id, text AS query FROM benchmark) AS q"
_BM25 = f"""
    tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents),
    dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM documents),
    n AS (SELECT count(*) AS n FROM documents), av AS (SELECT avg(dl) AS avgdl FROM dl),
    df AS (SELECT token, count(DISTINCT doc_id) AS df FROM tok GROUP BY token),
    raw AS (SELECT token, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, n),
    idf AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
    asked AS (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS token FROM {ASKED}),
    tf AS (SELECT doc_id, token, count(*) AS tf FROM tok WHERE token IN (SELECT token FROM asked) GROUP BY ALL),
    bm AS (SELECT query_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS raw FROM asked JOIN tf USING (token) JOIN idf USING (token) JOIN dl USING (doc_id), av GROUP BY ALL)"""


_OPEN: dict[tuple, str] = {}


def stored_index(spark: SparkSession, d: str) -> index.Index:
    """The stored index of documents and their vectors, built by the first query of an application that needs it, and
    again when the tables' files have changed."""
    at = (spark.sparkContext.applicationId, d, *[listing(spark, f"{d}/{t}.parquet") for t in ("documents", "embeddings")])
    if at not in _OPEN:
        path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        vectors = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
        index.build(read(spark, d, "documents"), path, "doc_id", F.col("text"), vectors)
        _OPEN[at] = path
    return index.load(spark, _OPEN[at])


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """All benchmark items as questions, with the vector of the same number, if there is one."""
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).join(v, "query_id", "left")


#: Scores that agree to 12 decimal places tie; they are rounded further only to be shown.
@query(f"""WITH {_BM25}, s AS (SELECT query_id, doc_id, round(raw / (raw + 6), 12) AS score FROM bm),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score, max(score) OVER (PARTITION BY query_id) >= 0.5 AS answerable FROM r WHERE rank <= 8""")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    top = index.lexical(_asked(spark, d), stored_index(spark, d))
    answerable = F.max("score").over(Window.partitionBy("query_id")) >= 0.5
    return top.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"), answerable.alias("answerable"))


@query(f"WITH {_BM25} SELECT token, df, round(idf, 6) AS idf FROM idf")
def bm25_idf_stats(spark: SparkSession, d: str) -> DataFrame:
    return search.idf(read(spark, d, "documents"), "doc_id", "text").select("token", "df", F.round("idf", 6).alias("idf"))


_LINES = r"""l AS (SELECT doc_id, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')))) AS line FROM documents),
    bp AS (SELECT line, count(*) AS pages FROM l WHERE line <> '' AND NOT regexp_matches(line, '^#{1,4}\s+\S') AND len(regexp_extract_all(line, '[^\s]+')) <= 25
      GROUP BY line HAVING count(*) >= greatest(2, floor((SELECT count(*) FROM documents) * 0.01)))"""


@query(f"WITH {_LINES} SELECT line, pages FROM bp")
def boilerplate_lines(spark: SparkSession, d: str) -> DataFrame:
    return clean.boilerplate(read(spark, d, "documents"), "doc_id", "text", 0.01)


@query(rf"""WITH {_LINES}, b AS (SELECT list(line) AS bad FROM bp),
    k AS (SELECT doc_id, string_split(text, chr(10)) AS ls, list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(b.bad, regexp_replace(x, '^\s+|\s+$', '', 'g'))) AS kept FROM documents, b)
    SELECT doc_id, md5(array_to_string(kept, chr(10))) AS body_md5, CAST(len(ls) - len(kept) AS INTEGER) AS removed FROM k""")
def boilerplate_strip(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    out = clean.strip_boilerplate(docs, "doc_id", "text", clean.boilerplate(docs, "doc_id", "text", 0.01))
    return out.select("doc_id", F.md5("body").alias("body_md5"), "removed")


_WARN = r"""v AS (SELECT doc_id, source, len(regexp_extract_all(text, '[^\s]+')) AS n, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '') AS ls, text FROM documents),
    w AS (SELECT doc_id, source, n, n < 40 AS thin, regexp_matches(text, '(?i)lorem ipsum|test page|coming soon') AS placeholder, len(ls) > 0 AND len(list_distinct(ls)) / len(ls) < 0.4 AS repetitive FROM v)"""


@query(f"""WITH {_WARN} SELECT doc_id, array_to_string(list_filter([CASE WHEN thin THEN 'thin content (' || n || ' words)' END, CASE WHEN placeholder THEN 'placeholder text detected' END,
    CASE WHEN repetitive THEN 'highly repetitive content, extraction may have failed' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM w WHERE thin OR placeholder OR repetitive""")
def validate_flags(spark: SparkSession, d: str) -> DataFrame:
    w = clean.warnings(F.col("text"), F.lit("t"))
    return read(spark, d, "documents").select("doc_id", F.array_join(w, "; ").alias("warnings")).filter("warnings <> ''")


@query(f"""WITH {_WARN}, f AS (SELECT CASE WHEN source = 'src0' THEN 0 WHEN thin THEN 1 WHEN repetitive THEN 2 ELSE 3 END AS step FROM w),
    r AS (SELECT step, reason, (SELECT count(*) FROM f WHERE f.step = r.step) AS dropped FROM (VALUES (0, 'irrelevant'), (1, 'thin'), (2, 'failed')) r(step, reason))
    SELECT step, reason, dropped, CAST((SELECT count(*) FROM f) - sum(dropped) OVER (ORDER BY step) AS BIGINT) AS remaining FROM r""")
def cleaning_funnel(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("source", clean.warnings(F.col("text"), F.lit("t")).alias("w"))
    has = lambda s: F.exists("w", lambda x: x.contains(s))
    return clean.funnel(rows, [("irrelevant", F.col("source") == "src0"), ("thin", has("thin content")), ("failed", has("extraction may have failed"))])


#: Patterns that fire on the synthetic texts, beside the library's own.
FIRING = {"email": r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]{2,}", "us_phone": r"\+1 \(\d{3}\) \d{3}-\d{4}", "ipv4": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "card": r"\d{16}"}
_FOUND = "[" + ", ".join(f"{{'label': '{k}', 'm': list_sort(list_distinct(regexp_extract_all(text, '{p}')))}}" for k, p in FIRING.items()) + "]"
_REDACT = "text"
for _k, _p in FIRING.items():
    _REDACT = f"regexp_replace({_REDACT}, '{_p}', '[{_k.upper()}_REDACTED]', 'g')"


@query(f"""SELECT doc_id, x.label AS label, array_to_string(x.m, ';') AS matches FROM (SELECT doc_id, unnest(list_filter({_FOUND}, lambda x: len(x.m) > 0)) AS x FROM documents)""")
def pii_detect(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.explode(T.pii_found(F.col("text"), FIRING)).alias("x")).select("doc_id", "x.label", F.array_join("x.matches", ";").alias("matches"))


@query(f"SELECT doc_id, md5(r) AS text_md5, regexp_matches(r, '\\[[A-Z_0-9]+_REDACTED\\]') AS pii FROM (SELECT doc_id, {_REDACT} AS r FROM documents)")
def pii_redact(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.redact(F.col("text"), FIRING).alias("r")).select("doc_id", F.md5("r").alias("text_md5"), F.col("r").rlike(r"\[[A-Z_0-9]+_REDACTED\]").alias("pii"))


@query(f"SELECT string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT x.label AS label FROM (SELECT unnest(list_filter({_FOUND}, lambda x: len(x.m) > 0)) AS x FROM documents))")
def pii_types_seen(spark: SparkSession, d: str) -> DataFrame:
    each = read(spark, d, "documents").select(F.explode(T.pii_found(F.col("text"), FIRING)).alias("x"))
    return each.agg(F.array_join(F.array_sort(F.collect_set("x.label")), ",").alias("labels"))


#: What is planted behind documents' texts, so that each rule of normalisation has work.
_PLANTED = """CASE doc_id % 6 WHEN 0 THEN 'Php 1,000 and ₱ 250 or P 12,345 but not P 12' WHEN 1 THEN 'Face amount of the Policy Holder, face AMOUNT; unit linked' WHEN 2 THEN 'due 5 March 2024 or march 15, 2024 or 31/12/2020, not 5 Mai 2024'
    WHEN 3 THEN concat('a\u00a0  b\u200b', chr(10), chr(10), chr(10), chr(10), 'c') WHEN 4 THEN 'mail me@example.com or 0917 123 4567, TIN 123-456-789, policy no. ABC-12345' ELSE 'ﬁne Ａ１ text' END"""
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _nested(sql: str, steps: list[tuple[str, str]]) -> str:
    """One regexp_replace in the other."""
    for pattern, to in steps:
        sql = f"regexp_replace({sql}, '{pattern}', '{to}', 'g')"
    return sql


_NORMAL = [("[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"[Pp]hp\s?([\d,]+)", r"PHP \1"), (r"₱\s?([\d,]+)", r"PHP \1"), (r"\bP\s?([\d,]{4,})", r"PHP \1")]
for _v, _c in T.TERMINOLOGY.items():
    _NORMAL += [(rf"\b{_v[0].upper()}(?i:{_v[1:]})\b", _c[0].upper() + _c[1:]), (rf"\b{_v[0]}(?i:{_v[1:]})\b", _c)]
_DMY = [(rf"(?i)\b(\d{{{k}}})\s+{m}\s+(\d{{4}})\b", rf"\2-{i:02d}-{'0' * (2 - k)}\1") for i, m in enumerate(_MONTHS, 1) for k in (1, 2)]
_MDY = [(rf"(?i)\b{m}\s+(\d{{{k}}}),?\s+(\d{{4}})\b", rf"\2-{i:02d}-{'0' * (2 - k)}\1") for i, m in enumerate(_MONTHS, 1) for k in (1, 2)]
_SLASH = [(rf"\b(\d{{{j}}})/(\d{{{k}}})/(\d{{4}})\b", rf"\3-{'0' * (2 - j)}\1-{'0' * (2 - k)}\2") for j in (1, 2) for k in (1, 2)]
_OWN_PII = "concat_ws(','" + "".join(f", CASE WHEN regexp_matches(t3, '{p}') THEN '{k}' END" for k, p in T.PII.items()) + ")"
_ANY = "|".join(_MONTHS)


@query(rf"""WITH a AS (SELECT doc_id, replace(replace(replace(concat(text, chr(10), {_PLANTED}), 'ﬁne Ａ１', 'fine A1'), chr(160), ' '), chr(8203), '') AS t FROM documents),
    n AS (SELECT doc_id, regexp_replace({_nested('t', _NORMAL)}, '^\s+|\s+$', '', 'g') AS t0 FROM a),
    d1 AS (SELECT doc_id, {_nested('t0', _DMY)} AS t1, len(regexp_extract_all(t0, '(?i)\b\d{{1,2}}\s+(?:{_ANY})\s+\d{{4}}\b')) AS n1 FROM n),
    d2 AS (SELECT doc_id, {_nested('t1', _MDY)} AS t2, n1 + len(regexp_extract_all(t1, '(?i)\b(?:{_ANY})\s+\d{{1,2}},?\s+\d{{4}}\b')) AS n2 FROM d1),
    d3 AS (SELECT doc_id, {_nested('t2', _SLASH)} AS t3, n2 + len(regexp_extract_all(t2, '\b\d{{1,2}}/\d{{1,2}}/\d{{4}}\b')) AS n3 FROM d2)
    SELECT doc_id, md5(t3) AS text_md5, CAST(n3 AS INTEGER) AS dates, {_OWN_PII} AS labels FROM d3""")
def normalise_text(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", T.normalise(T.nfkc(F.concat("text", F.lit("\n"), F.expr(_PLANTED)))).alias("n"))
    text, n = T.iso_dates(F.col("n"))
    t = docs.select("doc_id", text.alias("t"), n.cast("int").alias("dates"))
    return t.select("doc_id", F.md5("t").alias("text_md5"), "dates", F.array_join(F.transform(T.pii_found(F.col("t")), lambda x: x["label"]), ",").alias("labels"))


_TITLE = "CASE doc_id % 4 WHEN 0 THEN concat(source, '  page – ', 'Acme Site | home') WHEN 1 THEN concat(upper(replace(text, 'ß', 'ss')), ' | acme  site') WHEN 2 THEN concat(' ', text, ' ') ELSE upper(lang) END"


@query(rf"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({_TITLE}, '(?is)\s*[|–-]\s*acme\s+site.*$', ''), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS h FROM documents)
    SELECT doc_id, md5(CASE WHEN upper(h) = h AND lower(h) <> h AND length(h) > 8 THEN list_aggregate(list_transform(regexp_extract_all(h, '\p{{L}}+|\P{{L}}+'), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', '') ELSE h END) AS heading_md5 FROM t""")
def normalise_heading(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(T.heading(F.expr(_TITLE), r"[|–-]\s*acme\s+site")).alias("heading_md5"))


FILLERS = ["the", "that", "with", "of"]


@query(r"""WITH t AS (SELECT conv_id, turn, text, regexp_replace(regexp_replace(regexp_replace(text, '(?i)(?:the|that|with|of)', ' ', 'g'), '\s+', ' ', 'g'), '^[ ,.?!]+|[ ,.?!]+$', '', 'g') AS s
    FROM (SELECT conv_id, turn, regexp_replace(text, '[^a-zA-Z]+', ' ', 'g') AS text FROM conversations WHERE role = 'user'))
    SELECT conv_id, turn, CASE WHEN len(regexp_extract_all(s, '[^\s]+')) >= 2 THEN s ELSE text END AS query FROM t""".replace("(?i)(?:the|that|with|of)", r"(?i)\b(?:the|that|with|of)\b"))
def filler_strip(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").filter("role = 'user'").withColumn("text", F.regexp_replace("text", "[^a-zA-Z]+", " "))
    return c.select("conv_id", "turn", T.strip_fillers(F.col("text"), FILLERS).alias("query"))


_SHINGLES = r"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
    sh AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN ['_empty_'] WHEN len(w) < 4 THEN w ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END AS s FROM w)"""


@query(f"WITH {_SHINGLES} SELECT doc_id, CAST(len(s) AS INTEGER) AS shingles, CAST(len(list_distinct(s)) AS INTEGER) AS distinct_shingles FROM sh")
def shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.size(T.word_tokens(F.col("text"))) == 0, F.array(F.lit("_empty_"))).otherwise(T.shingles(F.col("text")))
    return read(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("shingles"), F.size(F.array_distinct("s")).alias("distinct_shingles"))


_SIMHASH = f"""{_SHINGLES}, hs AS (SELECT doc_id, ('0x' || substr(md5(unnest(s)), 1, 16))::UBIGINT AS h FROM sh),
    bits AS (SELECT doc_id, b, sum(CAST((h >> b) & 1 AS INTEGER) * 2 - 1) > 0 AS one FROM hs, range(64) t(b) GROUP BY ALL),
    fp AS (SELECT doc_id, CAST(sum(CASE WHEN one THEN CASE WHEN b = 63 THEN -9223372036854775808::HUGEINT ELSE 1::HUGEINT << b END ELSE 0 END) AS BIGINT) AS fingerprint FROM bits GROUP BY doc_id)"""


@query(f"WITH {_SIMHASH} SELECT doc_id, fingerprint FROM fp")
def simhash_md5(spark: SparkSession, d: str) -> DataFrame:
    return clean.simhash(read(spark, d, "documents"), "doc_id", "text")


_PAIRS = f"""{_SIMHASH}, one AS (SELECT fingerprint, min(doc_id) AS k FROM fp GROUP BY fingerprint),
    pairs AS (SELECT a.k AS x, b.k AS y, CAST(bit_count(xor(a.fingerprint, b.fingerprint)) AS INTEGER) AS distance FROM one a JOIN one b ON a.k < b.k AND bit_count(xor(a.fingerprint, b.fingerprint)) <= 4)"""


@query(f"WITH {_PAIRS} SELECT x, y, distance FROM pairs")
def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return clean.near_pairs(stage(clean.simhash(read(spark, d, "documents"), "doc_id", "text")), "doc_id")


@query(f"""WITH {_PAIRS}, n AS (SELECT r, count(*) AS links FROM (SELECT x AS r FROM pairs UNION ALL SELECT y FROM pairs) GROUP BY r)
    SELECT doc_id, k AS representative, coalesce(links, 0) AS links FROM fp JOIN one USING (fingerprint) LEFT JOIN n ON n.r = k""")
def near_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    prints = stage(clean.simhash(read(spark, d, "documents"), "doc_id", "text"))
    return clean.near_groups(prints, "doc_id", clean.near_pairs(prints, "doc_id"))


@query(f"""WITH RECURSIVE {_SIMHASH}, o AS MATERIALIZED (SELECT doc_id, fingerprint, row_number() OVER (ORDER BY len(regexp_extract_all(text, '[^\\s]+')) DESC, doc_id) AS i FROM documents JOIN fp USING (doc_id)),
    f AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS doc_id, NULL::BIGINT AS near, []::STRUCT(k BIGINT, p BIGINT)[] AS kept
      UNION ALL SELECT o.i, o.doc_id, c.near, CASE WHEN c.near IS NULL THEN list_append(f.kept, {{'k': o.doc_id, 'p': o.fingerprint}}) ELSE f.kept END
        FROM f JOIN o ON o.i = f.i + 1, LATERAL (SELECT list_filter(f.kept, lambda x: bit_count(xor(x.p, o.fingerprint)) <= 4)[1].k AS near) c)
    SELECT doc_id, near IS NULL AS kept, near AS duplicate_of FROM f WHERE i > 0""")
def dedupe_survivors(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    rows = docs.select("doc_id", T.word_count(F.col("text")).alias("words")).join(clean.simhash(docs, "doc_id", "text"), "doc_id")
    return clean.greedy_survivors(rows, "doc_id", "words", None)


SECTIONS = [("en", "english"), ("fr", "french"), ("es", "spanish")]
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]+/*([^?#]*)', 1)"
_CATEGORY = f"CASE WHEN starts_with({_PATH}, 'en') THEN 'english' WHEN starts_with({_PATH}, 'fr') THEN 'french' WHEN starts_with({_PATH}, 'es') THEN 'spanish' WHEN starts_with({_PATH}, 'de') THEN 'noise' END"


@query(f"SELECT page_id, {_CATEGORY} AS category FROM pages")
def url_categorise(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", web.categorise(F.col("url"), SECTIONS, "de").alias("category"))


@query(f"WITH c AS (SELECT url, {_CATEGORY} AS category FROM (SELECT DISTINCT url FROM pages)) SELECT * FROM c WHERE category <> 'noise' UNION ALL SELECT * FROM (SELECT * FROM c WHERE category = 'noise' ORDER BY url LIMIT 5)")
def url_select(spark: SparkSession, d: str) -> DataFrame:
    return web.select_urls(read(spark, d, "pages").select("url").distinct(), "url", SECTIONS, "de", 5)


@query(f"SELECT page_id, coalesce(nullif(substr(replace(trim({_PATH}, '/'), '/', '_'), 1, 70), ''), 'index') || '__' || substr(sha256(url), 1, 16) || '.html' AS cache_file FROM pages")
def cache_name(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", web.cache_name(F.col("url")).alias("cache_file"))


@query("SELECT status, count(*) AS pages FROM (SELECT CASE WHEN length(html) < 2000 THEN 'too_small' ELSE 'ok' END AS status FROM pages) GROUP BY status")
def fetch_status(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").groupBy(web.fetch_status(F.lit(200), F.col("html")).alias("status")).agg(F.count(F.lit(1)).alias("pages"))


_OUT = r"regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<svg\b.*?</svg\s*>|<iframe\b.*?</iframe\s*>|<form\b.*?</form\s*>|<button\b.*?</button\s*>', ' ', 'g')"
_PLAIN = rf"regexp_replace(regexp_replace({_OUT}, '(?i)<br\s*/?>|</(p|li|h[1-4]|td|th|div)>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
for _e, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_e}', '{_c}')"
_PLAIN = rf"regexp_replace(regexp_replace(regexp_replace({_PLAIN}, '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT page_id, md5({_PLAIN}) AS body_md5, CAST(len(regexp_extract_all({_PLAIN}, '[^\\s]+')) AS INTEGER) AS words FROM pages")
def plain_extraction(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages").select("page_id", extract.strip_html(F.col("html")).alias("b"))
    return p.select("page_id", F.md5("b").alias("body_md5"), T.word_count(F.col("b")).alias("words"))


@query()
def best_of_extractors(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract_pages(read(spark, d, "pages"), "page_id", "html")


def _headed(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose lines of one word become headings, of level 1 or 2 by length, so that sections exist."""
    line = lambda x: F.when(x.rlike(r"^[^\s]+$"), F.concat(F.when(F.length(x) % 2 == 0, "# ").otherwise("## "), x)).otherwise(x)
    return read(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("body"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
    h AS (SELECT *, CASE WHEN regexp_matches(x, '^[^\s]+$') THEN CASE WHEN length(x) % 2 = 0 THEN 1 ELSE 2 END END AS lv FROM l),
    s AS (SELECT *, count(lv) OVER (PARTITION BY doc_id ORDER BY pos) AS section, last_value(CASE WHEN lv = 1 THEN x END IGNORE NULLS) OVER w AS h1, last_value(CASE WHEN lv = 2 THEN x END IGNORE NULLS) OVER w AS h2,
      last_value(CASE WHEN lv = 1 THEN pos END IGNORE NULLS) OVER w AS p1, last_value(CASE WHEN lv = 2 THEN pos END IGNORE NULLS) OVER w AS p2 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    g AS (SELECT doc_id, section, any_value(h1) AS h1, any_value(CASE WHEN p2 > coalesce(p1, -1) THEN h2 END) AS h2, regexp_replace(string_agg(CASE WHEN lv IS NULL THEN x END, chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g') AS content FROM s GROUP BY ALL)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1 AS INTEGER) AS section, concat_ws(' > ', h1, h2) AS path, md5(content) AS content_md5 FROM g WHERE coalesce(content, '') <> ''""")
def heading_sections(spark: SparkSession, d: str) -> DataFrame:
    s = chunk.sections(_headed(spark, d), "doc_id", "body")
    return s.select("doc_id", "section", F.array_join("heading_path", " > ").alias("path"), F.md5("content").alias("content_md5"))


_CUT_SECTIONS = r"""l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
    h AS (SELECT *, CASE WHEN regexp_matches(x, '^[^\s]+$') THEN CASE WHEN length(x) % 2 = 0 THEN 1 ELSE 2 END END AS lv FROM l),
    s AS (SELECT *, count(lv) OVER w AS section, last_value(CASE WHEN lv = 1 THEN x END IGNORE NULLS) OVER w AS h1, last_value(CASE WHEN lv = 2 THEN x END IGNORE NULLS) OVER w AS h2,
      last_value(CASE WHEN lv = 1 THEN pos END IGNORE NULLS) OVER w AS p1, last_value(CASE WHEN lv = 2 THEN pos END IGNORE NULLS) OVER w AS p2 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    g AS (SELECT doc_id, any_value(source) AS source, section, any_value(h1) AS h1, any_value(CASE WHEN p2 > coalesce(p1, -1) THEN h2 END) AS h2, regexp_replace(string_agg(CASE WHEN lv IS NULL THEN x END, chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g') AS content FROM s GROUP BY doc_id, section),
    c AS (SELECT *, len(regexp_extract_all(content, '[^\s]+')) AS n FROM g WHERE coalesce(content, '') <> ''),
    u AS (SELECT doc_id, section, unnest(list_filter(string_split(replace(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(10), chr(1)), chr(1)), lambda x: regexp_matches(x, '\S'))) AS u, unnest(range(len(list_filter(string_split(replace(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(10), chr(1)), chr(1)), lambda x: regexp_matches(x, '\S'))))) AS k FROM c WHERE n > 320),
    uw AS (SELECT *, regexp_extract_all(u, '[^\s]+') AS w FROM u),
    se AS (SELECT doc_id, section, k, unnest(CASE WHEN len(w) <= 180 THEN [u] ELSE list_transform(range((len(w) - 1) // 180 + 1), lambda i: array_to_string(w[i * 180 + 1:(i + 1) * 180], ' ')) END) AS t, unnest(range(CASE WHEN len(w) <= 180 THEN 1 ELSE (len(w) - 1) // 180 + 1 END)) AS r FROM uw),
    sent AS MATERIALIZED (SELECT doc_id, section, list(t ORDER BY k, r) AS ts, list(len(regexp_extract_all(t, '[^\s]+')) ORDER BY k, r) AS ns FROM se GROUP BY doc_id, section),
    f(doc_id, section, i, done, now, n) AS (SELECT doc_id, section, 1, []::VARCHAR[], NULL::VARCHAR, 0::BIGINT FROM sent
      UNION ALL SELECT doc_id, section, i + 1, CASE WHEN is_full THEN list_append(done, now) ELSE done END,
          CASE WHEN now IS NULL THEN t WHEN is_full THEN array_to_string(tail, ' ') || ' ' || t ELSE now || ' ' || t END, CASE WHEN is_full THEN len(tail) + m ELSE n + m END
        FROM (SELECT f.*, ts[i] AS t, ns[i] AS m, now IS NOT NULL AND n + ns[i] > 180 AS is_full, regexp_extract_all(coalesce(now, ''), '[^\s]+')[-30:] AS tail FROM f JOIN sent ON f.doc_id = sent.doc_id AND f.section = sent.section WHERE i <= len(ts))),
    e AS (SELECT f.doc_id, f.section, CASE WHEN now IS NULL THEN done WHEN len(done) > 0 AND len(regexp_extract_all(now, '[^\s]+')) < 25 THEN list_append(done[:len(done) - 1], done[len(done)] || ' ' || now) ELSE list_append(done, now) END AS ps FROM f JOIN sent ON f.doc_id = sent.doc_id AND f.section = sent.section WHERE i = len(ts) + 1),
    p AS (SELECT c.*, unnest(CASE WHEN n <= 320 THEN [content] ELSE ps END) AS piece, unnest(range(CASE WHEN n <= 320 THEN 1 ELSE len(ps) END)) AS k FROM c LEFT JOIN e ON e.doc_id = c.doc_id AND e.section = c.section),
    z AS (SELECT *, len(regexp_extract_all(piece, '[^\s]+')) AS wc FROM p)"""


@query(rf"""WITH RECURSIVE {_CUT_SECTIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section, k) - 1 AS chunk_index FROM z WHERE wc >= 25)
    SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, printf('%d_c%02d', doc_id, chunk_index) AS chunk_id, coalesce(h2, h1, source) AS heading, CAST(wc AS INTEGER) AS word_count, regexp_matches(piece, '\[[A-Z_]+_REDACTED\]') AS pii,
      md5(regexp_replace(piece, '^\s+|\s+$', '', 'g')) AS content_md5 FROM o""")
def chunk_records(spark: SparkSession, d: str) -> DataFrame:
    c = chunk.chunks(_headed(spark, d), "doc_id", "title", "body")
    return c.select("doc_id", "chunk_index", "chunk_id", "heading", "word_count", "pii", F.md5("content").alias("content_md5"))


@query("SELECT source, min(n) AS least, list_sort(list(n))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS upper_median, max(n) AS most FROM (SELECT source, CAST(len(regexp_extract_all(text, '[^\\s]+')) AS INTEGER) AS n FROM documents) GROUP BY source")
def chunk_size_stats(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "documents").select("source", T.word_count(F.col("text")).alias("n"))
    return reports.chunk_sizes(n, ["source"], "n", F.array()).select("source", "least", "upper_median", "most")


_VEC = """qv AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
    sc AS (SELECT query_id, vec_id, label, round(list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 12) AS score FROM qv, embeddings)"""


def _nearest(spark: SparkSession, d: str, queries: str = "vec_id % 20 = 0", pool: str = "true") -> DataFrame:
    """The nearest 8 of some vectors for the vectors whose number is divisible by 20, or for the ones beside them."""
    e = read(spark, d, "embeddings").withColumnRenamed("embedding", "vector")
    q = e.filter(queries).select((F.col("vec_id") - F.col("vec_id") % 20).alias("query_id"), "vector")
    return topk.nearest(q, e.filter(pool), "vec_id")


@query(f"WITH {_VEC} SELECT query_id, vec_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sc) WHERE rank <= 8")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d).withColumn("score", F.round("score", 5))


@query(f"""WITH {_VEC} SELECT query_id, vec_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sc WHERE label = 3) WHERE rank <= 8""")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d, pool="label = 3").withColumn("score", F.round("score", 5))


_TOP = f"""{_BM25}, qv AS (SELECT item_id AS query_id, embedding AS q FROM benchmark LEFT JOIN embeddings ON vec_id = item_id),
    dv AS (SELECT doc_id, embedding AS v FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
    sc AS (SELECT query_id, doc_id, coalesce(list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(v AS DOUBLE[])), 0) AS vector_score FROM qv, dv),
    fu AS (SELECT sc.query_id, sc.doc_id, vector_score, coalesce(raw, 0) / (coalesce(raw, 0) + 6) AS bm25_score FROM sc LEFT JOIN bm ON bm.query_id = sc.query_id AND bm.doc_id = sc.doc_id),
    fs AS (SELECT *, round(0.6 * vector_score + 0.4 * bm25_score, 12) AS score FROM fu),
    top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM fs QUALIFY rank <= 8)"""


def _top(spark: SparkSession, d: str) -> DataFrame:
    """The hybrid search's results for all benchmark items over all documents, with a vector or without."""
    return index.hybrid(_asked(spark, d), stored_index(spark, d))


@query(f"WITH {_TOP} SELECT query_id, doc_id, round(vector_score, 4) AS vector_score, round(bm25_score, 4) AS bm25_score, round(score, 4) AS score, rank FROM top")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    shown = [F.round(c, 4).alias(c) for c in ("vector_score", "bm25_score", "score")]
    return _top(spark, d).select("query_id", "doc_id", *shown, "rank")


@query(f"""WITH {_TOP} SELECT query_id, rank, round_even(vector_score * 0.6, 4) AS vector_part, round_even(bm25_score * 0.4, 4) AS bm25_part, doc_id % 2 = 0 AS cited FROM top""")
def search_parts(spark: SparkSession, d: str) -> DataFrame:
    return reports.score_parts(_top(spark, d), F.col("doc_id") % 2 == 0).select("query_id", "rank", "vector_part", "bm25_part", "cited")


@query(f"WITH {_TOP} SELECT query_id, round(greatest(0.5 * 1.6, max(score), 0.2), 4) AS scale FROM top GROUP BY query_id")
def score_scale(spark: SparkSession, d: str) -> DataFrame:
    return reports.display_scale(_top(spark, d), "query_id", "score", 0.5).withColumn("scale", F.round("scale", 4))


def _first_words() -> Callable:
    """A stand-in for an answering model: the prompt's first words with a citation, or the refusal token."""
    return lambda c: F.when(F.length(c) % 3 == 0, F.lit("NO_ANSWER")).otherwise(F.concat(F.substring(c, 1, 12), F.lit(" [faq_x]")))


@query(rf"""WITH {_TOP}, g AS (SELECT query_id, max(score) >= 0.5 AS ok, string_agg(CAST(t.doc_id AS VARCHAR), ',' ORDER BY rank) AS retrieved, string_agg('[' || t.doc_id || '] ' || d.text, chr(10) || chr(10) ORDER BY rank) AS context FROM top t JOIN documents d ON d.doc_id = t.doc_id GROUP BY query_id),
    q AS (SELECT item_id AS query_id, text, CASE WHEN item_id % 4 = 0 THEN 'own passage' ELSE '' END AS own FROM benchmark),
    p AS (SELECT query_id, retrieved, ok OR own <> '' AS asked, text || chr(10) || chr(10) || own || chr(10) || chr(10) || context AS prompt FROM q JOIN g USING (query_id)),
    a AS (SELECT query_id, retrieved, CASE WHEN NOT asked THEN 'retrieval' WHEN length(prompt) % 3 = 0 THEN 'generation' ELSE 'none' END AS gate, substr(prompt, 1, 12) AS head FROM p)
    SELECT query_id, regexp_replace(CASE WHEN gate = 'none' THEN head ELSE '' END, '^\s+|\s+$', '', 'g') AS text, gate <> 'none' AS refused, gate, CASE WHEN gate = 'none' THEN 'faq_x' ELSE '' END AS invalid, gate = 'none' AS grounded, retrieved FROM a""")
def answered(spark: SparkSession, d: str) -> DataFrame:
    q, at = _asked(spark, d), stored_index(spark, d)
    at = replace(at, chunks=at.chunks.withColumnRenamed("text", "content"))
    own = q.filter("query_id % 4 = 0").select("query_id", F.lit("own passage").alias("passage"))
    a = index.answer(q, _top(spark, d), at, _first_words(), "NO_ANSWER", own)
    return a.select("query_id", "text", "refused", "gate", F.array_join("invalid", ",").alias("invalid"), "grounded", F.array_join("retrieved", ",").alias("retrieved"))


@query(f"""WITH {_VEC}, qt AS (SELECT vec_id - 1 AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 1),
    st AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 12) AS score FROM qt, embeddings),
    v AS (SELECT query_id, vec_id, score, 0 AS variant FROM sc UNION ALL SELECT query_id, vec_id, score, 1 FROM st),
    b AS (SELECT query_id, vec_id, max(score) AS score, min(variant) FILTER (WHERE score = top) AS variant FROM (SELECT *, max(score) OVER (PARTITION BY query_id, vec_id) AS top FROM v) GROUP BY ALL)
    SELECT query_id, vec_id, round(score, 5) AS score, variant, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM b) WHERE rank <= 8""")
def merge_variants(spark: SparkSession, d: str) -> DataFrame:
    both = [_nearest(spark, d), _nearest(spark, d, "vec_id % 20 = 1")]
    return search.merge_variants(both, "vec_id").select("query_id", "vec_id", F.round("score", 5).alias("score"), "variant", "rank")


@query(f"""WITH {_TOP} SELECT query_id, rank, CASE WHEN vector_score >= 0.5 THEN 'strong' WHEN vector_score >= 0.3 THEN 'moderate' ELSE 'weak' END || ' semantic match' AS semantic,
    CASE WHEN bm25_score >= 0.5 THEN 'strong' WHEN bm25_score >= 0.2 THEN 'some' ELSE 'little' END || ' keyword overlap' AS keywords FROM top""")
def explain_bands(spark: SparkSession, d: str) -> DataFrame:
    said = search.explain(F.col("vector_score"), F.col("bm25_score"))
    return _top(spark, d).select("query_id", "rank", F.regexp_extract(said, r"^[a-z ]+ match", 0).alias("semantic"), F.regexp_extract(said, r"[a-z]+ keyword overlap", 0).alias("keywords"))


_BEST = f"""{_BM25}, s AS (SELECT query_id, doc_id, round(raw / (raw + 6), 12) AS score FROM bm), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 8),
    t AS (SELECT query_id, query_id % 2 AS part, query_id % 3 = 0 AS refuse, max(score) AS top_score, list(lang ORDER BY rank) AS cats FROM r JOIN documents USING (doc_id) GROUP BY query_id)"""


def _best(spark: SparkSession, d: str) -> DataFrame:
    """Of each benchmark item: the best score, and the languages of its results in order. A third must be refused."""
    top = index.lexical(_asked(spark, d), stored_index(spark, d)).join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    cats = F.transform(F.array_sort(F.collect_list(F.struct("rank", "lang"))), lambda x: x["lang"])
    return top.groupBy("query_id").agg(F.max("score").alias("top_score"), cats.alias("cats")).select("query_id", (F.col("query_id") % 2).alias("part"), (F.col("query_id") % 3 == 0).alias("must_refuse"), "top_score", "cats")


_GATES = f"""{_BEST}, g AS (SELECT part, min(top_score) FILTER (WHERE NOT refuse) AS lo, max(top_score) FILTER (WHERE refuse) AS hi, quantile_cont(top_score, 0.5) FILTER (WHERE NOT refuse) AS mid, list_sort(list(top_score) FILTER (WHERE NOT refuse)) AS ls FROM t GROUP BY part)"""


@query(f"""WITH {_GATES} SELECT part, round_even(lo, 3) AS answerable_min, round_even(ls[CAST(floor(len(ls) / 2) AS INTEGER) + 1], 3) AS answerable_median, round_even(mid, 3) AS answerable_mid, round_even(hi, 3) AS unanswerable_max,
    lo > hi AS separable, round_even((lo + hi) / 2, 3) AS suggested_threshold, round_even(greatest(0.05, lo - 0.03), 3) AS gate FROM g""")
def calibrate_threshold(spark: SparkSession, d: str) -> DataFrame:
    return search.calibrate(_best(spark, d), ["part"])


@query(f"""WITH {_GATES} SELECT part, query_id, CASE WHEN refuse THEN 'would be answered' ELSE 'would be refused' END AS fate FROM t JOIN g USING (part) WHERE refuse = (top_score >= round_even(greatest(0.05, lo - 0.03), 3))""")
def gate_lists(spark: SparkSession, d: str) -> DataFrame:
    scores = _best(spark, d)
    return search.gate_lists(scores, search.calibrate(scores, ["part"]), ["part"], "query_id")


@query(f"""WITH {_BEST}, e AS (SELECT *, CASE WHEN query_id % 5 <> 0 THEN 'en' END AS expected FROM t),
    v AS (SELECT CASE WHEN refuse THEN CASE WHEN top_score < 0.5 THEN 'correct' ELSE 'incorrect' END WHEN expected IS NULL THEN CASE WHEN top_score >= 0.5 THEN 'partially correct' ELSE 'incorrect' END
      WHEN cats[1] = expected THEN 'correct' WHEN list_contains(cats, expected) THEN 'partially correct' ELSE 'incorrect' END AS verdict FROM e) SELECT verdict, count(*) AS n FROM v GROUP BY verdict""")
def retrieval_verdicts(spark: SparkSession, d: str) -> DataFrame:
    v = search.verdict(F.col("must_refuse"), F.when(F.col("query_id") % 5 != 0, "en"), F.col("top_score"), F.col("cats"))
    return _best(spark, d).groupBy(v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


#: Answers of a model that state passages, after the turns' own texts.
_ANSWER = "concat(text, CASE WHEN turn % 3 = 0 THEN ' [kb_a_001_c02] and [faq_hours]. [kb_a_001_c02]' WHEN turn % 3 = 1 THEN '' ELSE concat(' Both [kb_z_', conv_id, '_c1]', chr(10), '[kb_b_002_c00] [not cited]') END)"
_GOT = "CASE WHEN conv_id % 2 = 0 THEN 'kb_a_001_c02,kb_b_002_c00' ELSE concat('kb_z_', conv_id, '_c1') END"


@query(rf"""WITH a AS (SELECT conv_id, turn, {_ANSWER} AS t, string_split({_GOT}, ',') AS got FROM conversations),
    c AS (SELECT *, list_sort(list_distinct(regexp_extract_all(t, '\[((?:faq_[a-z0-9_]+)|(?:[a-z0-9_]+_c\d+))\]', 1))) AS stated FROM a)
    SELECT conv_id, turn, md5(regexp_replace(regexp_replace(t, '\s*\[((?:faq_[a-z0-9_]+)|(?:[a-z0-9_]+_c\d+))\]', '', 'g'), '^\s+|\s+$', '', 'g')) AS spoken_md5,
      array_to_string(list_filter(stated, lambda x: list_contains(got, x)), ',') AS valid, array_to_string(list_filter(stated, lambda x: NOT list_contains(got, x)), ',') AS invalid FROM c""")
def citation_validate(spark: SparkSession, d: str) -> DataFrame:
    valid, invalid = search.validate_citations(T.citations(F.col("t")), F.split("got", ","))
    a = read(spark, d, "conversations").select("conv_id", "turn", F.expr(_ANSWER).alias("t"), F.expr(_GOT).alias("got"))
    return a.select("conv_id", "turn", F.md5(T.strip_citations(F.col("t"))).alias("spoken_md5"), F.array_join(valid, ",").alias("valid"), F.array_join(invalid, ",").alias("invalid"))


@query(f"""WITH {_VEC}, r AS (SELECT query_id, vec_id, label, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sc QUALIFY rank <= 8),
    u AS (SELECT *, vec_id % 2 = 0 AS cited, max(CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS a FROM r)
    SELECT query_id, label, vec_id, CAST(rank AS INTEGER) AS rank FROM u WHERE a = 0 OR cited QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY rank) = 1""")
def answer_sources(spark: SparkSession, d: str) -> DataFrame:
    top = _nearest(spark, d).join(read(spark, d, "embeddings").select("vec_id", "label"), "vec_id").withColumn("cited", F.col("vec_id") % 2 == 0)
    return search.answer_sources(top, "cited", "vec_id", "label").select("query_id", "label", "vec_id", "rank")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").filter("role in ('user', 'assistant')")
    return c.select("conv_id", "turn", F.when(F.col("role") == "assistant", "agent").otherwise("caller").alias("speaker"), "text")


def _word(*w: str) -> str:
    return r"(^|[^\p{L}\p{N}_])(" + "|".join(w) + r")([^\p{L}\p{N}_]|$)"


#: Rules that fire on the synthetic texts.
FIRING_RISKY, FIRING_CUES = [("risky_statement", 0.95, _word("that"), "a")], [("buying_signal", 0.8, _word("with", "und"), "b"), ("callback_needed", 0.5, _word("from", "der"), "c")]
FIRING_GAP = [("first", _word("the"), _word("this"), "say this"), ("second", _word("is", "ist"), _word("was"), "say was")]
_TURNS = "t AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'agent' ELSE 'caller' END AS speaker, text FROM conversations WHERE role IN ('user', 'assistant'))"
_CUE = " UNION ALL ".join(f"SELECT conv_id, turn, '{t}' AS type, {c}::DOUBLE AS confidence, regexp_extract(text, '(?i){p}', 0) AS evidence FROM t WHERE speaker {op} 'agent' AND regexp_matches(text, '(?i){p}')" for op, rules in (("=", FIRING_RISKY), ("<>", FIRING_CUES)) for t, c, p, _ in rules)


@query(f"WITH {_TURNS} {_CUE}")
def cue_signals(spark: SparkSession, d: str) -> DataFrame:
    return signals.cue_signals(_turns(spark, d), "conv_id", "turn", FIRING_RISKY, FIRING_CUES).select("conv_id", "turn", "type", "confidence", "evidence")


_GAP = " UNION ALL ".join(
    f"SELECT conv_id, turn, '{i}' AS disclosure FROM (SELECT conv_id, turn, min(CASE WHEN regexp_matches(text, '(?i){a}') THEN turn END) OVER w AS f, max(CASE WHEN speaker = 'agent' AND regexp_matches(text, '(?i){b}') THEN 1 ELSE 0 END) OVER w AS m, max(CASE WHEN speaker = 'agent' THEN turn END) OVER w AS l FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE m = 0 AND l > f"
    for i, a, b, _ in FIRING_GAP
)


@query(f"WITH {_TURNS} {_GAP}")
def disclosure_gaps(spark: SparkSession, d: str) -> DataFrame:
    return signals.disclosure_gaps(_turns(spark, d), "conv_id", "turn", FIRING_GAP).select("conv_id", "turn", "disclosure")


#: What is planted behind turns, so that the library's own rules have work.
_SAID = """CASE (conv_id * 7 + turn) % 11 WHEN 0 THEN 'Our funds give guaranteed returns' WHEN 1 THEN 'My wife would like that' WHEN 2 THEN 'You should buy this, there is no risk' WHEN 3 THEN 'I can''t afford much, call me later'
    WHEN 4 THEN 'this is not a deposit and not guaranteed' WHEN 5 THEN 'what''s the next step for my second car' WHEN 6 THEN 'your date of birth please' WHEN 7 THEN 'this call is recorded, data privacy act' WHEN 8 THEN 'definitely approved by a licensed advisor' ELSE '' END"""
_PLANTED_TURNS = f"t AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'agent' ELSE 'caller' END AS speaker, concat(text, ' ', {_SAID}) AS text FROM conversations WHERE role IN ('user', 'assistant'))"


def _quoted(x: str) -> str:
    return x.replace("'", "''")


_OWN = " UNION ALL ".join(
    f"SELECT conv_id, turn, '{t}' AS type, {c}::DOUBLE AS confidence, regexp_extract(text, '(?i){_quoted(p)}', 0) AS evidence, {signals.PRIORITY[t]} AS priority, '{_quoted(n)}' AS nudge FROM t WHERE speaker {op} 'agent' AND regexp_matches(text, '(?i){_quoted(p)}')"
    for op, rules in (("=", signals.RISKY), ("<>", signals.CUES))
    for t, c, p, n in rules
)
_OWN += " UNION ALL " + " UNION ALL ".join(
    f"""SELECT conv_id, turn, 'compliance_gap', {signals.GAP_CONFIDENCE}, e, {signals.PRIORITY['compliance_gap']}, '{_quoted(n)}' FROM (SELECT conv_id, turn, min(CASE WHEN regexp_matches(text, '(?i){a}') THEN turn END) OVER w AS f, first_value(CASE WHEN regexp_matches(text, '(?i){a}') THEN regexp_extract(text, '(?i){a}', 0) END IGNORE NULLS) OVER w AS e,
    max(CASE WHEN speaker = 'agent' AND regexp_matches(text, '(?i){b}') THEN 1 ELSE 0 END) OVER w AS m, max(CASE WHEN speaker = 'agent' THEN turn END) OVER w AS l FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE m = 0 AND l > f"""
    for _, a, b, n in signals.DISCLOSURES
)


@query(f"WITH {_PLANTED_TURNS} {_OWN}")
def rules_fixture(spark: SparkSession, d: str) -> DataFrame:
    """The library's own rules over all turns, planted ones among them."""
    t = _turns(spark, d).withColumn("text", F.concat("text", F.lit(" "), F.expr(_SAID)))
    both = signals.cue_signals(t, "conv_id", "turn").unionByName(signals.disclosure_gaps(t, "conv_id", "turn"))
    return signals.with_dims(both).select("conv_id", "turn", "type", "confidence", "evidence", "priority", "nudge")


_ADVICE = """concat(text, CASE turn % 7 WHEN 0 THEN ' Give a specific projected return' WHEN 1 THEN ' Offer a discount now' WHEN 2 THEN ' Skip the disclosure' WHEN 3 THEN ' Say what they''ll earn' WHEN 4 THEN ' Promises approval' WHEN 5 THEN ' GUARANTEES it' ELSE ' Ask about family' END)"""
_REASON = "CASE " + " ".join(f"WHEN regexp_matches(t, '(?i){_quoted(p)}') THEN '{r}'" for p, r in signals.PROHIBITED) + " ELSE '' END"


@query(f"SELECT conv_id, turn, {_REASON} AS reason FROM (SELECT conv_id, turn, {_ADVICE} AS t FROM conversations)")
def nudge_safety(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", signals.unsafe_reason(F.expr(_ADVICE)).alias("reason"))


def _offered(spark: SparkSession, d: str) -> DataFrame:
    """Events as signals: the user is the call, the type the signal's, the value the confidence, time in minutes."""
    kinds = F.create_map(*[F.lit(x) for kv in (("signup", "buying_signal"), ("error", "compliance_gap"), ("click", "missed_cross_sell"), ("view", "topic_shift"), ("purchase", "callback_needed")) for x in kv])
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 600
    return read(spark, d, "events").select(F.col("user_id").alias("call"), at.alias("at"), kinds[F.col("event_type")].alias("type"), F.least(F.col("value") / 20, F.lit(1.0)).alias("confidence"), F.get_json_object("props", "$.k").alias("evidence"), F.lit("").alias("nudge"), F.lit(None).cast("string").alias("disclosure"))


_ENGINE = """k AS (SELECT * FROM (VALUES ('signup', 'buying_signal', 60, 30.0, 0.55), ('error', 'compliance_gap', 100, 45.0, 0.4), ('click', 'missed_cross_sell', 50, 60.0, 0.55), ('view', 'topic_shift', 20, 90.0, 0.55), ('purchase', 'callback_needed', 40, 60.0, 0.55)) AS k(event_type, type, priority, cooldown, floor)),
    o AS (SELECT CAST(user_id AS VARCHAR) AS call, epoch_us(ts) / 1e6 / 600 AS "at", type, priority, cooldown::DOUBLE AS cooldown, floor::DOUBLE AS floor, least(value / 20, 1.0) AS confidence, type || ':' || json_extract_string(props, '$.k') AS key FROM events JOIN k USING (event_type)),
    s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY call ORDER BY "at", priority DESC, key) AS i FROM o),
    f AS (SELECT DISTINCT call, 0::BIGINT AS i, NULL::DOUBLE AS "at", NULL::VARCHAR AS type, NULL::INTEGER AS priority, NULL::VARCHAR AS fate, 0 AS n, MAP {}::MAP(VARCHAR, DOUBLE) AS last, []::VARCHAR[] AS seen FROM s
      UNION ALL SELECT call, i, "at", type, priority, fate, n + CASE WHEN fate = 'emitted' THEN 1 ELSE 0 END, CASE WHEN fate = 'emitted' THEN map_concat(last, MAP {type: "at"}) ELSE last END, CASE WHEN fate = 'emitted' THEN list_append(seen, key) ELSE seen END
        FROM (SELECT s.*, f.n, f.last, f.seen, CASE WHEN s.confidence < s.floor THEN 'low_confidence' WHEN list_contains(f.seen, s.key) THEN 'duplicate' WHEN s."at" - f.last[s.type] < s.cooldown THEN 'cooldown' ELSE 'emitted' END AS fate FROM f JOIN s ON s.call = f.call AND s.i = f.i + 1)),
    fates AS (SELECT call, "at", type, priority, fate AS outcome, CASE WHEN fate = 'emitted' THEN 'n' || lpad(CAST(n AS VARCHAR), 3, '0') END AS nudge_id, '' AS text, '' AS rewrite_reason FROM f WHERE i > 0)"""


@query(f"WITH RECURSIVE {_ENGINE} SELECT * FROM fates")
def nudge_engine(spark: SparkSession, d: str) -> DataFrame:
    return signals.nudges(_offered(spark, d), "call", "at")


@query(f"""WITH RECURSIVE {_ENGINE}, g AS (SELECT type, count(*) AS signals_seen, count(*) FILTER (WHERE outcome = 'low_confidence') AS dropped_low_confidence, count(*) FILTER (WHERE outcome = 'duplicate') AS dropped_duplicate,
    count(*) FILTER (WHERE outcome = 'cooldown') AS dropped_cooldown, 0::BIGINT AS unsafe_text_rewritten, 0::BIGINT AS unsafe_text_dropped, count(*) FILTER (WHERE outcome = 'emitted') AS nudges_emitted FROM fates GROUP BY type)
    SELECT *, round_even(1 - nudges_emitted / signals_seen, 3) AS suppression_rate FROM g""")
def suppression_stats(spark: SparkSession, d: str) -> DataFrame:
    return signals.suppression(nudge_engine(spark, d), ["type"])


@query("SELECT user_id AS call, count(*) AS signals, count(DISTINCT event_type || json_extract_string(props, '$.k')) AS distinct FROM events GROUP BY user_id")
def distinct_evidence(spark: SparkSession, d: str) -> DataFrame:
    return signals.distinct_evidence(_offered(spark, d), "call")


_MIN = "epoch_us(ts) / 1e6 / 600"


@query(f"""WITH n AS (SELECT user_id AS call, event_id AS nudge_id, {_MIN} AS a, event_type = 'error' AS critical, CASE event_type WHEN 'error' THEN 'compliance_gap' ELSE 'buying_signal' END AS type, CASE event_type WHEN 'error' THEN 100 ELSE CAST(event_id % 7 AS INTEGER) END AS priority FROM events),
    k AS (SELECT DISTINCT user_id AS call, floor({_MIN} / 200) * 200 AS tick FROM events)
    SELECT k.call, k.tick, nudge_id, CAST(row_number() OVER (PARTITION BY k.call, tick, critical ORDER BY priority DESC, a, nudge_id) AS INTEGER) AS place FROM k JOIN n ON n.call = k.call AND a <= tick AND tick - a <= 90 QUALIFY critical OR place <= 3""")
def active_nudges(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 600
    e = read(spark, d, "events").select(F.col("user_id").alias("call"), F.col("event_id").alias("nudge_id"), at.alias("at"), "event_type")
    n = e.select("call", "nudge_id", "at", F.when(F.col("event_type") == "error", "compliance_gap").otherwise("buying_signal").alias("type"), F.when(F.col("event_type") == "error", 100).otherwise((F.col("nudge_id") % 7).cast("int")).alias("priority"))
    ticks = e.select("call", (F.floor(F.col("at") / 200) * 200.0).alias("tick")).distinct()
    return signals.active(n, ticks).select("call", "tick", "nudge_id", "place")


@query(rf"WITH {_TURNS} SELECT conv_id, turn, md5(string_agg(speaker || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS 5 PRECEDING)) AS window_md5 FROM t")
def judge_windows(spark: SparkSession, d: str) -> DataFrame:
    return calls.last_turns(_turns(spark, d), "conv_id", "turn").select("conv_id", "turn", F.md5("window").alias("window_md5"))


@query(f"""WITH RECURSIVE {_TURNS}, o AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM t),
    f AS (SELECT conv_id, i, turn, CASE WHEN n >= 160 THEN 0 ELSE n END AS acc, n >= 160 AS due FROM o WHERE i = 1
      UNION ALL SELECT o.conv_id, o.i, o.turn, CASE WHEN f.acc + o.n >= 160 THEN 0 ELSE f.acc + o.n END, f.acc + o.n >= 160 FROM f JOIN o ON o.conv_id = f.conv_id AND o.i = f.i + 1)
    SELECT conv_id, turn FROM f WHERE due""")
def judge_triggers(spark: SparkSession, d: str) -> DataFrame:
    return calls.judge_triggers(_turns(spark, d), "conv_id", "turn")


@query(rf"""WITH {_TURNS}, b AS (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY conv_id ORDER BY turn) <> speaker THEN 1 ELSE 0 END AS c FROM t),
    g AS (SELECT *, CAST(sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS bubble FROM b)
    SELECT conv_id, bubble, speaker, md5(string_agg(text, ' ' ORDER BY turn)) AS text_md5, count(*) AS turns FROM g GROUP BY ALL""")
def bubble_merge(spark: SparkSession, d: str) -> DataFrame:
    return calls.bubbles(_turns(spark, d), "conv_id", "turn").select("conv_id", "bubble", "speaker", F.md5("text").alias("text_md5"), "turns")


@query(f"WITH {_TURNS} SELECT conv_id, turn, coalesce(last_value(CASE WHEN speaker = 'agent' AND text <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), 'hello') AS last_said FROM t")
def last_agent_utterance(spark: SparkSession, d: str) -> DataFrame:
    return calls.last_said(_turns(spark, d), "conv_id", "turn", default="hello").select("conv_id", "turn", "last_said")


@query("""SELECT event_type, count(value) AS count, round_even(quantile_cont(value, 0.5), 1) AS p50_ms, round_even(quantile_cont(value, 0.95), 1) AS p95_ms, round_even(min(value), 1) AS min_ms, round_even(max(value), 1) AS max_ms,
    round_even(avg(value), 1) AS mean_ms, CAST(row_number() OVER (ORDER BY min(event_id), event_type) AS INTEGER) AS place FROM events GROUP BY event_type""")
def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    return calls.latency_summary(read(spark, d, "events"), "event_type", "value", "event_id")


@query("""SELECT event_type, CAST(row_number() OVER (ORDER BY avg(value), event_type) AS INTEGER) AS place, round_even(lead(avg(value)) OVER (ORDER BY avg(value), event_type) / avg(value), 2) AS speedup FROM events GROUP BY event_type""")
def latency_ranked(spark: SparkSession, d: str) -> DataFrame:
    return calls.ranked_latency(read(spark, d, "events"), "event_type", "value").select("event_type", "place", "speedup")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts, n DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS events FROM s GROUP BY user_id, k""")
def session_segments(spark: SparkSession, d: str) -> DataFrame:
    s = calls.sessions(read(spark, d, "events"), "user_id", "ts", "6 hours")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


@query("""WITH RECURSIVE v AS MATERIALIZED (SELECT user_id AS call, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value * 20 >= 180 AS voiced FROM events),
    f AS (SELECT DISTINCT call, -1::BIGINT AS i, 0::BIGINT AS run, NULL::BIGINT AS start, 0::BIGINT AS last, NULL::BIGINT AS a, NULL::BIGINT AS b FROM v
      UNION ALL SELECT call, i, CASE WHEN start IS NOT NULL THEN CASE WHEN shut THEN 0 ELSE run END WHEN voiced THEN run + 1 ELSE 0 END,
          CASE WHEN start IS NOT NULL THEN CASE WHEN NOT shut THEN start END WHEN voiced AND run + 1 >= 2 THEN i - 1 END, CASE WHEN voiced THEN i + 1 ELSE last END, CASE WHEN shut THEN start END, CASE WHEN shut THEN CASE WHEN voiced THEN i + 1 ELSE last END END
        FROM (SELECT v.*, f.run, f.start, f.last, f.start IS NOT NULL AND (v.i + 1 - CASE WHEN v.voiced THEN v.i + 1 ELSE f.last END >= 6 OR v.i + 1 - f.start >= 120) AS shut FROM f JOIN v ON v.call = f.call AND v.i = f.i + 1)),
    s AS (SELECT call, a, b FROM f WHERE a IS NOT NULL UNION ALL SELECT call, start, last FROM f WHERE start IS NOT NULL QUALIFY i = max(i) OVER (PARTITION BY call) AND i = (SELECT max(v.i) FROM v WHERE v.call = f.call))
    SELECT CAST(call AS VARCHAR) AS call, 'caller' AS speaker, 'c' || row_number() OVER (PARTITION BY call ORDER BY a) AS utt_id, round(a * 0.1, 2) AS start_s, round(b * 0.1, 2) AS end_s FROM s""")
def vad_segments(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    f = e.select(F.col("user_id").cast("string").alias("call"), F.lit("caller").alias("speaker"), (F.row_number().over(w) - 1).alias("frame"), (F.col("value") * 20).alias("rms"))
    return calls.speech_segments(f)


@query("""SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL AS first,
    round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS start_s FROM events""")
def track_offsets(spark: SparkSession, d: str) -> DataFrame:
    t = calls.track_offsets(read(spark, d, "events"), "user_id", "event_id", "value")
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) == 1
    return t.select("user_id", "event_id", first.alias("first"), F.round("start_s", 4).alias("start_s"))


_SLOTS = "o_custkey, sum(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS b, sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS c, sum(CASE WHEN o_orderpriority LIKE '5%' THEN 1 ELSE 0 END) AS d, count(*) AS n FROM orders GROUP BY o_custkey"


@query(f"""WITH s AS (SELECT {_SLOTS}), p AS (SELECT o_custkey, CAST(1 + CASE WHEN a > 0 THEN 3 ELSE 0 END + CASE WHEN b > 0 THEN 2 ELSE 0 END + CASE WHEN c > 0 THEN 2 ELSE 0 END + CASE WHEN d > 0 THEN 1 ELSE 0 END + CASE WHEN n > 12 THEN 2 ELSE 0 END AS INTEGER) AS score FROM s)
    SELECT o_custkey, score, CASE WHEN score / 11 >= 0.75 THEN 'hot' WHEN score / 11 >= 0.45 THEN 'warm' ELSE 'cold' END AS band FROM p""")
def lead_score(spark: SparkSession, d: str) -> DataFrame:
    read(spark, d, "orders").createOrReplaceTempView("orders")
    s = spark.sql(f"SELECT {_SLOTS}")
    yes = lambda c: F.when(c, "x").otherwise("")
    slots = F.create_map(F.lit("name"), F.lit("x"), F.lit("dependents"), yes(F.col("a") > 0), F.lit("existing_cover"), yes(F.col("b") > 0), F.lit("interest"), yes(F.col("c") > 0), F.lit("age_band"), yes(F.col("d") > 0), F.lit("callback"), yes(F.col("n") > 12))
    score, band = calls.lead_score(slots)
    return s.select("o_custkey", score.alias("score"), band.alias("band"))


_CITED = "list_distinct(regexp_extract_all(text, '[a-z]{9,}'))"


@query(f"""WITH {_TURNS}, m AS (SELECT *, {_CITED} AS c, speaker = 'agent' AND length(text) % 2 = 0 AS g, speaker = 'agent' AND length(text) % 2 = 1 AS r FROM t),
    l AS (SELECT *, CASE WHEN speaker = 'caller' THEN 'CALLER: ' ELSE 'AGENT : ' END || text || CASE WHEN len(c) > 0 THEN '   [cited: ' || array_to_string(list_sort(c), ', ') || ']' WHEN g THEN '   [grounded in: a, b, c]' WHEN r THEN '   [refused at retrieval gate]' ELSE '' END AS line FROM m)
    SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE g) AS grounded_answers, count(*) FILTER (WHERE len(c) > 0) AS answers_with_stated_citation, count(*) FILTER (WHERE r) AS refusals, md5(string_agg(line, chr(10) ORDER BY turn)) AS transcript_md5 FROM l GROUP BY conv_id""")
def call_summary(spark: SparkSession, d: str) -> DataFrame:
    agent, even = F.col("speaker") == "agent", F.length("text") % 2 == 0
    t = _turns(spark, d).withColumns({"citations": F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]{9,}"), F.lit(0)))), "grounded": agent & even, "refused": agent & ~even, "refusal_gate": F.lit("retrieval"), "retrieved_ids": F.array(*[F.lit(x) for x in "abcd"])})
    return calls.call_summaries(t, "conv_id", "turn").withColumn("transcript_md5", F.md5("transcript")).drop("transcript")


@query("""WITH s AS (SELECT o_custkey AS call_id, count(*) AS n, min(o_orderpriority) AS p, max(o_orderstatus) AS st FROM orders GROUP BY o_custkey),
    v AS (SELECT call_id, CASE WHEN n > 10 THEN 'Ana' ELSE '' END AS name, p AS dependents, CASE WHEN st = 'P' THEN 'later' ELSE '' END AS callback FROM s),
    w AS (SELECT *, 3 + CASE WHEN name <> '' THEN 1 ELSE 0 END + CASE WHEN callback <> '' THEN 2 ELSE 0 END AS score FROM v)
    SELECT 'lead_' || call_id AS lead_id, name, callback, dependents, score, CASE WHEN score / 11 >= 0.75 THEN 'hot' WHEN score / 11 >= 0.45 THEN 'warm' ELSE 'cold' END AS score_band, '3/6' AS slots_filled FROM w""")
def lead_rows(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("call_id")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderpriority").alias("p"), F.max("o_orderstatus").alias("st"))
    slots = F.create_map(F.lit("name"), F.when(F.col("n") > 10, "Ana").otherwise(""), F.lit("dependents"), F.col("p"), F.lit("callback"), F.when(F.col("st") == "P", "later").otherwise(""))
    rows = calls.leads(s.select("call_id", F.lit("m").alias("market"), slots.alias("slots"), F.lit(6).alias("slots_total"), F.lit("ended").alias("final_state"), F.lit(False).alias("escalated"), F.lit(0).alias("grounded_answers"), F.lit(0).alias("refusals")))
    return rows.select("lead_id", "contact.name", F.col("contact.preferred_callback").alias("callback"), "qualification.dependents", "score", "score_band", "slots_filled")


@query(f"""WITH {_TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM t)
    SELECT conv_id AS call_id, 'asked' AS reason, md5(string_agg(speaker || ': ' || text, chr(10) ORDER BY turn)) AS recent_md5, count(*) AS recent FROM r WHERE k <= 6 AND conv_id % 2 = 0 GROUP BY conv_id""")
def escalation_rows(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d)
    s = t.select(F.col("conv_id").alias("call_id")).distinct().select("call_id", F.lit("m").alias("market"), F.lit("asked").alias("escalation_reason"), F.create_map(F.lit("name"), F.lit("x")).alias("slots"), (F.col("call_id") % 2 == 0).alias("escalated"))
    e = calls.escalations(s, t, "conv_id", "turn")
    text = F.array_join(F.transform("recent_turns", lambda x: F.concat_ws(": ", x["speaker"], x["text"])), "\n")
    return e.select("call_id", "reason", F.md5(text).alias("recent_md5"), F.size("recent_turns").cast("long").alias("recent"))


@query("""SELECT event_id, count(*) FILTER (WHERE value < 5) OVER w AS attempt, value < 5 AND count(*) FILTER (WHERE value < 5) OVER w = 3 AS skips FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def slot_attempts(spark: SparkSession, d: str) -> DataFrame:
    return calls.running_attempts(read(spark, d, "events"), "user_id", "event_type", "event_id", F.col("value") < 5).select("event_id", "attempt", "skips")


@query("SELECT user_id, event_type, count(*) FILTER (WHERE value < 5) AS attempts, count(*) FILTER (WHERE value < 5) >= 3 AS skipped FROM events GROUP BY ALL")
def slot_skip(spark: SparkSession, d: str) -> DataFrame:
    return calls.attempts_skipped(read(spark, d, "events"), "user_id", "event_type", F.col("value") < 5)


_INTENTS = {"signup": "agree", "error": "objection", "click": "answer", "view": "question", "purchase": "answer"}
_FSM = f"""t AS MATERIALIZED (SELECT CAST(user_id AS VARCHAR) AS call, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, MAP {{{', '.join(f"'{k}': '{v}'" for k, v in _INTENTS.items())}}}[event_type] AS intent, json_extract_string(props, '$.k') AS value, value > 10 AS fits, value > 99.5 AS esc FROM events),
    f AS (SELECT DISTINCT call, 0::BIGINT AS i, 'greeting' AS st, 0 AS filled, []::VARCHAR[] AS skipped, 0 AS tries FROM t
      UNION ALL SELECT call, i, CASE WHEN st IN ('ended', 'escalated') THEN st WHEN esc THEN 'escalated' WHEN intent = 'question' THEN 'answering' WHEN intent = 'objection' THEN 'objection'
            WHEN (intent = 'answer' AND fits OR vain AND tries = 2) AND filled + len(skipped) + CASE WHEN puts OR vain THEN 1 ELSE 0 END >= 6 THEN 'ended' WHEN intent = 'answer' AND fits OR st <> 'greeting' OR intent = 'agree' THEN 'qualifying' ELSE st END,
          filled + CASE WHEN puts THEN 1 ELSE 0 END, CASE WHEN vain AND tries = 2 THEN list_append(skipped, ['dependents', 'existing_cover', 'interest', 'age_band', 'callback', 'name'][filled + len(skipped) + 1]) ELSE skipped END,
          CASE WHEN puts OR vain AND tries = 2 THEN 0 WHEN vain THEN tries + 1 ELSE tries END
        FROM (SELECT t.*, f.st, f.filled, f.skipped, f.tries, f.st NOT IN ('ended', 'escalated') AND NOT t.esc AND f.filled + len(f.skipped) < 6 AS live,
            live AND t.fits AND t.value <> '' AND (t.intent = 'answer' OR t.intent = 'question' AND f.st IN ('greeting', 'qualifying')) AS puts,
            live AND f.st <> 'greeting' AND (t.intent = 'agree' OR t.intent = 'answer' AND NOT (t.fits AND t.value <> '')) AS vain FROM f JOIN t ON t.call = f.call AND t.i = f.i + 1))"""


@query(f"WITH RECURSIVE {_FSM} SELECT call, CAST(i AS INTEGER) AS turns, st AS final_state, filled AS slots_filled, array_to_string(skipped, ',') AS skipped FROM f QUALIFY i = max(i) OVER (PARTITION BY call)")
def fsm_final_state(spark: SparkSession, d: str) -> DataFrame:
    intents = F.create_map(*[F.lit(x) for kv in _INTENTS.items() for x in kv])
    t = read(spark, d, "events").select(F.col("user_id").cast("string").alias("call"), F.col("event_id").alias("at"), intents[F.col("event_type")].alias("intent"), F.get_json_object("props", "$.k").alias("value"), (F.col("value") > 10).alias("fits"), (F.col("value") > 99.5).alias("escalate"))
    return calls.conversations(t, tuple(calls.LEAD_WEIGHTS))


@query(rf"""WITH RECURSIVE {_TURNS}, w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS a, regexp_extract_all(lower(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)), '[\p{{L}}\p{{N}}_]+') AS b FROM t),
    p AS MATERIALIZED (SELECT * FROM w WHERE b IS NOT NULL),
    edits(conv_id, turn, i, j, cost) AS (SELECT conv_id, turn, 0::BIGINT, j, j FROM (SELECT conv_id, turn, unnest(range(len(b) + 1)) AS j FROM p)
      UNION ALL SELECT conv_id, turn, i + 1, j, min(cost - j) OVER (PARTITION BY conv_id, turn ORDER BY j) + j
        FROM (SELECT e.conv_id, e.turn, i, j, CASE WHEN j = 0 THEN i + 1 ELSE least(cost + 1, lag(cost) OVER (PARTITION BY e.conv_id, e.turn ORDER BY j) + CASE WHEN a[i + 1] = b[j] THEN 0 ELSE 1 END) END AS cost
          FROM edits e JOIN p ON p.conv_id = e.conv_id AND p.turn = e.turn WHERE i < len(a)))
    SELECT p.conv_id, p.turn, CASE WHEN len(a) = 0 THEN 0 ELSE round(cost / len(a), 6) END AS wer FROM p JOIN edits e ON e.conv_id = p.conv_id AND e.turn = p.turn AND i = len(a) AND j = len(b)""")
def wer(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d).withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("next is not null")
    return t.select("conv_id", "turn", F.round(calls.word_error_rate(T.word_tokens(F.col("text")), T.word_tokens(F.col("next"))), 6).alias("wer"))


@query("""WITH f AS (SELECT user_id, list_distinct(list(event_type)) AS fired FROM events GROUP BY user_id)
    SELECT user_id, array_to_string(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: NOT list_contains(fired, x)), ',') AS missing, CAST(len(fired) AS INTEGER) AS fired FROM f""")
def missing_signals(spark: SparkSession, d: str) -> DataFrame:
    f = read(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("f"))
    expected = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    return f.select("user_id", F.array_join(calls.missing_signals(expected, F.col("f")), ",").alias("missing"), F.size("f").alias("fired"))


_LINE = """CASE (conv_id + turn) % 5 WHEN 0 THEN '' WHEN 1 THEN concat(text, ' Salamat, thank you for your time') WHEN 2 THEN concat('Well I''ll go. ', text) WHEN 3 THEN NULL ELSE text END"""


@query(rf"""WITH l AS (SELECT concat(conv_id, ':', turn) AS name, {_LINE} AS line FROM conversations), m AS (SELECT name, line, regexp_extract(line, '(?i){_quoted(calls.ENGLISH)}', 0) AS e FROM l)
    SELECT name, CASE WHEN coalesce(line, '') = '' THEN 'EMPTY' ELSE 'English marker: ' || e END AS finding FROM m WHERE coalesce(line, '') = '' OR e <> ''""")
def language_leak(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "conversations").select(F.concat("conv_id", F.lit(":"), "turn").alias("name"), F.expr(_LINE).alias("line"))
    return calls.language_leaks(lines, "name", "line")


@query("SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    broken = F.when(F.col("event_id") % 7 == 0, F.regexp_replace("props", "[}]", "")).otherwise(F.col("props"))
    return read(spark, d, "events").select("event_id", calls.model_output(broken, "k int").getField("k").alias("k"))


@query("""WITH x AS (SELECT event_id, event_type, value, unnest([0, 1, 2]) AS i FROM events WHERE event_id % 5 <> 0)
    SELECT event_id, CASE i WHEN 0 THEN 'buying_signal' ELSE 'topic_shift' END AS type, CASE WHEN i > 0 OR event_id % 3 = 1 THEN 0.5 WHEN event_id % 3 = 0 THEN value ELSE 0.25 END AS confidence, CASE i WHEN 0 THEN repeat('w', 160) ELSE '' END AS evidence, CASE i WHEN 0 THEN repeat('n', 200) ELSE event_type END AS nudge
    FROM x WHERE i < 2 AND NOT (i = 1 AND event_type = 'view')""")
def judged_signals(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    one = F.struct(F.lit("buying_signal").alias("type"), F.when(F.col("event_id") % 3 == 0, F.col("value").cast("string")).when(F.col("event_id") % 3 == 1, F.lit("high")).otherwise(F.lit("0.25")).alias("confidence"), F.lit("w" * 300).alias("evidence"), F.lit("n" * 300).alias("nudge"))
    two = F.struct(F.when(F.col("event_type") == "view", "mood").otherwise("topic_shift").alias("type"), F.lit(None).cast("string").alias("confidence"), F.lit(None).cast("string").alias("evidence"), F.col("event_type").alias("nudge"))
    raw = F.to_json(F.struct(F.array(one, two, one).alias("signals")))
    answers = e.select("event_id", F.when(F.col("event_id") % 5 == 0, F.substring(raw, 1, 40)).otherwise(raw).alias("raw"))
    return calls.judged_signals(answers, "raw", signals.JUDGED)


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'unclear' WHEN event_type IN ('view', 'click') THEN event_type ELSE 'unclear' END AS intent, CASE WHEN event_id % 5 = 0 THEN '' ELSE json_extract_string(props, '$.k') END AS slot_value, event_id % 5 <> 0 AND value > 10 AS value_fits FROM events""")
def classified_turns(spark: SparkSession, d: str) -> DataFrame:
    raw = F.to_json(F.struct(F.col("event_type").alias("intent"), F.get_json_object("props", "$.k").alias("slot_value"), (F.col("value") > 10).alias("value_fits")))
    c = calls.classified(F.when(F.col("event_id") % 5 == 0, F.substring(raw, 1, 9)).otherwise(raw), ("view", "click"))
    return read(spark, d, "events").select("event_id", c.alias("c")).select("event_id", "c.intent", "c.slot_value", "c.value_fits")


@query("""SELECT '| event_type | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || event_type || ' | ' || n || ' |', chr(10) ORDER BY event_type) AS markdown FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)""")
def markdown_report(spark: SparkSession, d: str) -> DataFrame:
    return calls.rows_to_markdown(read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), ["event_type", "n"], "event_type")


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS day_us, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("event_type", F.window("t", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.unix_micros("w.start").alias("day_us"), "events", "total")


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_revenue(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def customers_without_large_orders(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").join(read(spark, d, "orders").filter("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT source, lang, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, source, lang) AS INTEGER) AS place FROM documents GROUP BY source, lang")
def group_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.counts(read(spark, d, "documents"), "source", "lang")


@query(r"""WITH w AS (SELECT source, len(regexp_extract_all(text, '[^\s]+')) AS words, quality FROM documents LEFT JOIN labels USING (doc_id)),
    f AS (SELECT source, 'all=' || count(*) || ' > labelled=' || count(quality) || ' > good=' || count(*) FILTER (WHERE quality = 1) AS funnel, count(quality) AS labelled, count(*) AS chunks, round(avg(words), 2) AS mean_words FROM w GROUP BY source)
    SELECT source, chunks, mean_words, funnel FROM f""")
def corpus_overview(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    g = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n0"), F.count("quality").alias("n1"), F.count_if(F.col("quality") == 1).alias("n2"))
    steps = g.select("source", F.posexplode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"n{i}").alias("n")) for i, name in enumerate(("all", "labelled", "good"))])).alias("step", "s")).select("source", "step", "s.name", "s.n")
    return reports.corpus_overview(read(spark, d, "documents").select("source").distinct(), steps, docs.select("source", T.word_count(F.col("text")).alias("words")), "source").select("source", "chunks", "mean_words", "funnel")


@query("SELECT event_type, day, n, round(n / first_value(n) OVER (PARTITION BY event_type ORDER BY day), 4) AS share FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)")
def stage_shares(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return reports.funnel_shares(n, "event_type", "day", "n")


@query("SELECT l.lang AS corpus, s.market FROM (SELECT DISTINCT lang FROM documents) l LEFT JOIN (SELECT lang, min(source) AS market FROM documents WHERE source <> 'src0' GROUP BY lang) s ON s.lang = l.lang")
def first_market(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("lang").alias("corpus"), F.col("source").alias("market"))
    return reports.first_market(docs.select("corpus").distinct(), docs.filter("market <> 'src0'").distinct(), "corpus", "market")


@query("SELECT n_name AS voice, r_name AS hint, s AS sentence FROM nation, region, (VALUES ('a'), ('b')) AS t(s)")
def trial_matrix(spark: SparkSession, d: str) -> DataFrame:
    return reports.trials(read(spark, d, "nation").select(F.col("n_name").alias("voice")), read(spark, d, "region").select(F.col("r_name").alias("hint")), values(spark, "(VALUES ('a'), ('b')) AS t(sentence)"))


_TRIALS = "w AS (SELECT event_id, event_type, user_id % 3 AS hint, value / 100 AS wer FROM events), g AS (SELECT 'event_type x hint' AS grouping, event_type || ' / ' || hint AS \"group\", count(*) AS trials, round_even(avg(wer), 3) AS mean_wer FROM w GROUP BY event_type, hint UNION ALL SELECT 'event_type', event_type, count(*), round_even(avg(wer), 3) FROM w GROUP BY event_type)"


def _trials(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", "event_type", (F.col("user_id") % 3).alias("hint"), (F.col("value") / 100).alias("wer"))


@query(f"WITH {_TRIALS} SELECT * FROM g")
def wer_by_group(spark: SparkSession, d: str) -> DataFrame:
    return reports.error_rates(_trials(spark, d), "wer", ["event_type", "hint"], ["event_type"])


@query(f"WITH {_TRIALS} SELECT event_id, wer FROM w ORDER BY wer DESC, event_id LIMIT 5")
def worst_trials(spark: SparkSession, d: str) -> DataFrame:
    return reports.worst(_trials(spark, d), "wer", "event_id").select("event_id", "wer")


@query(f"""WITH {_TRIALS} SELECT round_even((SELECT mean_wer FROM g WHERE "group" = 'error') / (SELECT mean_wer FROM g WHERE "group" = 'view'), 2) AS ratio""")
def wer_ratio(spark: SparkSession, d: str) -> DataFrame:
    return reports.worse_by(reports.error_rates(_trials(spark, d), "wer", ["event_type"]), "error", "view")


@query("SELECT event_type, count(*) AS runs, count(*) FILTER (WHERE event_id % 4 = 0) AS json, count(*) FILTER (WHERE event_id % 4 = 1) AS refused, count(*) FILTER (WHERE event_id % 4 = 2) AS failed FROM events GROUP BY event_type")
def model_capabilities(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    out = F.when(k == 0, F.concat(F.lit(" "), "props")).when(k == 1, F.lit("I say NO_ANSWER")).when(k == 2, F.lit("FAILED: timeout")).otherwise("fine")
    return reports.capabilities(read(spark, d, "events").select("event_type", out.alias("o")), "event_type", "o", "NO_ANSWER")


@query("""SELECT page_id, literal FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '"([^"\n]{12,})"', 1))) AS literal FROM pages)""")
def source_literals(spark: SparkSession, d: str) -> DataFrame:
    return reports.literals(read(spark, d, "pages"), "page_id", "html")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS at, base64(encode(props)) AS audio, props AS back FROM events")
def wire_forms(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", reports.iso_time(F.col("ts").cast("timestamp")).alias("at"), F.base64(F.encode("props", "utf-8")).alias("audio"))
    return e.withColumn("back", F.decode(F.unbase64("audio"), "utf-8"))


@query("""WITH s AS (SELECT user_id, list(event_id ORDER BY event_id) AS x FROM events GROUP BY user_id) SELECT user_id, array_to_string(x[greatest(0, floor((0.5 - 0.2) * 10)) + 1 : least(len(x), floor((1.5 + 0.2) * 10))], ',') AS clip FROM s""")
def sample_clips(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("x"))
    return s.select("user_id", F.array_join(reports.sample_range(F.col("x"), F.lit(0.5), F.lit(1.5), 10), ",").alias("clip"))


@query("""SELECT event_type AS stage, count(value) AS count, round_even(quantile_cont(value, 0.5), 1) AS p50_ms, round_even(quantile_cont(value, 0.95), 1) AS p95_ms, round_even(min(value), 1) AS min_ms, round_even(max(value), 1) AS max_ms,
    round_even(avg(value), 1) AS mean_ms, CAST(row_number() OVER (ORDER BY min((user_id % 2) * 1e9 + event_id), event_type) AS INTEGER) AS place FROM events GROUP BY event_type""")
def merged_latency(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"), F.col("event_id").alias("seq"), "user_id")
    return calls.latency_summary(reports.merged_spans(e.filter("user_id % 2 = 0"), e.filter("user_id % 2 = 1")), "stage", "ms", "seq")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def without_broken(spark: SparkSession, d: str) -> DataFrame:
    return reports.without(read(spark, d, "documents").select("doc_id", "lang"), read(spark, d, "labels").filter("quality = 0"), "doc_id")


@query(f"""WITH n AS (SELECT user_id AS call, event_id AS nudge_id, {_MIN} AS a FROM events), k AS (SELECT DISTINCT user_id AS call, floor({_MIN} / 200) * 200 AS tick FROM events),
    s AS (SELECT k.call, k.tick, nudge_id FROM k JOIN n ON n.call = k.call AND a <= tick AND tick - a <= 90)
    SELECT call, tick, nudge_id FROM s WHERE NOT (nudge_id % 3 = 0 AND (nudge_id * 7 % 500) <= tick)""")
def dismissed_nudges(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 600
    n = read(spark, d, "events").select(F.col("user_id").alias("call"), F.col("event_id").alias("nudge_id"), at.alias("at"), F.lit("compliance_gap").alias("type"), F.lit(100).alias("priority"))
    ticks = n.select("call", (F.floor(F.col("at") / 200) * 200.0).alias("tick")).distinct()
    gone = n.filter("nudge_id % 3 = 0").select("call", "nudge_id", (F.col("nudge_id") * 7 % 500).cast("double").alias("at"))
    return signals.active(n, ticks, dismissals=gone).select("call", "tick", "nudge_id")


@query(f"WITH {_TURNS} SELECT e.event_id, t.text, t.speaker FROM events e LEFT JOIN t ON t.conv_id = e.user_id AND t.turn = e.event_id % 4")
def nudge_lines(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "events").select("event_id", F.col("user_id").alias("call"), (F.col("event_id") % 4).alias("utt_id"))
    t = _turns(spark, d).select(F.col("conv_id").alias("call"), F.col("turn").alias("utt_id"), "speaker", "text")
    return signals.with_transcript(n, t).select("event_id", "text", "speaker")


@query(f"SELECT page_id, {_PATH} LIKE 'en%' AS allowed FROM pages")
def robots_audit(spark: SparkSession, d: str) -> DataFrame:
    rules = web.Robots(200, "User-agent: *\nAllow: /en\nDisallow: /")
    ok, blocked = web.audit_robots(read(spark, d, "pages").select("page_id", "url"), "url", rules, "bot")
    return ok.select("page_id", F.lit(True).alias("allowed")).unionByName(blocked.select("page_id", F.lit(False).alias("allowed")))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 9) AS rms FROM embeddings")
def frame_rms(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", F.round(calls.rms(F.col("embedding")), 9).alias("rms"))


_LEVELS = "SELECT user_id, 400 * row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 250 AS t_ms, value / 500 AS level FROM events"


@query(f"SELECT user_id, round(greatest(coalesce(avg(level) FILTER (WHERE t_ms < 350) * 2.2, 0.011), 0.011), 9) AS threshold FROM ({_LEVELS}) GROUP BY user_id")
def noise_floor(spark: SparkSession, d: str) -> DataFrame:
    return calls.noise_floor(_levels(spark, d), "user_id", "t_ms", "level").withColumn("threshold", F.round("threshold", 9))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    """Events as frames of a microphone's level, 400 ms apart, a capture a user."""
    t = 400 * F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 250
    return read(spark, d, "events").select("user_id", t.alias("t_ms"), (F.col("value") / 500).alias("level"))


@query(f"""WITH f AS (SELECT user_id, t_ms, level, coalesce(lag(t_ms) OVER (PARTITION BY user_id ORDER BY t_ms), 0) AS b FROM ({_LEVELS})),
    c AS (SELECT *, b < 350 AS cal, greatest(avg(CASE WHEN b < 350 THEN level END) OVER (PARTITION BY user_id) * 2.2, 0.011) AS threshold FROM f),
    l AS (SELECT *, NOT cal AND level > threshold AS loud FROM c),
    s AS (SELECT *, sum(CASE WHEN loud THEN t_ms - b ELSE 0 END) OVER w AS speech, max(CASE WHEN loud THEN t_ms END) OVER w AS heard FROM l WINDOW w AS (PARTITION BY user_id ORDER BY t_ms)),
    e AS (SELECT *, CASE WHEN speech >= 300 AND NOT loud AND t_ms - heard >= 1200 THEN 'silence' WHEN t_ms >= 30000 THEN 'timeout' END AS ended FROM s),
    g AS (SELECT user_id, any_value(threshold) AS threshold, min(CASE WHEN speech >= 300 THEN t_ms END) AS armed, min(CASE WHEN ended IS NOT NULL THEN t_ms END) AS stopped, arg_min(ended, t_ms) FILTER (WHERE ended IS NOT NULL) AS reason FROM e GROUP BY user_id)
    SELECT user_id, round(threshold, 9) AS threshold, CASE WHEN stopped IS NULL OR armed <= stopped THEN armed END AS armed_ms, stopped AS stopped_ms, reason FROM g""")
def client_captures(spark: SparkSession, d: str) -> DataFrame:
    return calls.captures(_levels(spark, d), "user_id", "t_ms", "level").withColumn("threshold", F.round("threshold", 9))


_HEARD = "CASE (conv_id + turn) % 6 WHEN 0 THEN ' Thank you. ' WHEN 1 THEN 'um' WHEN 2 THEN '...' WHEN 3 THEN 'Thank you, bye' ELSE text END"
_SILENT = ", ".join(f"'{x}'" for x in signals.SILENCE)


@query(f"SELECT conv_id, turn, coalesce(lower(trim(t)) NOT IN ({_SILENT}), true) AS heard FROM (SELECT conv_id, turn, {_HEARD} AS t FROM conversations)")
def heard_turns(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "conversations").select("conv_id", "turn", F.expr(_HEARD).alias("t"))
    return t.select("conv_id", "turn", (~F.coalesce(signals.is_artifact(F.col("t")), F.lit(False))).alias("heard"))


@query("""WITH a AS (SELECT event_id FROM events WHERE event_id % 3 <> 0), b AS (SELECT event_id FROM events WHERE event_id % 2 = 0)
    SELECT event_id, 'retire' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT event_id, 'add' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def panel_changes(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id")
    return signals.snapshot_changes(e.filter("event_id % 3 <> 0"), e.filter("event_id % 2 = 0"), "event_id")


@query("""SELECT doc_id, source || ' — ' || CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN lang ELSE lang || ' > part ' || doc_id END || CASE WHEN doc_id % 2 = 0 THEN ' (http://h/' || doc_id || ')' ELSE '' END AS label,
    CASE WHEN doc_id % 3 = 0 THEN md5(source || '. ' || text) WHEN doc_id % 3 = 1 THEN md5(source || '. ' || lang || '. ' || text) ELSE md5(source || '. ' || lang || ' > part ' || doc_id || '. ' || text) END AS embedded_md5 FROM documents""")
def citation_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    path = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array("lang")).otherwise(F.array("lang", F.concat(F.lit("part "), F.col("doc_id").cast("string"))))
    url = F.concat(F.lit("http://h/"), F.col("doc_id").cast("string"))
    label = F.when(F.col("doc_id") % 2 == 0, search.citation_label(F.col("source"), F.col("p"), url)).otherwise(search.citation_label(F.col("source"), F.col("p")))
    docs = read(spark, d, "documents").withColumn("p", path)
    return docs.select("doc_id", label.alias("label"), F.md5(chunk.embedding_text(F.col("source"), F.col("p"), F.col("text"))).alias("embedded_md5"))


_SPOKEN = "CASE doc_id % 4 WHEN 0 THEN 'English' WHEN 1 THEN 'Filipino and English' WHEN 2 THEN '' ELSE 'Bahasa Indonesia' END"
_WRITTEN = "CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE 'Bahasa' END"


@query(f"SELECT doc_id, a <> '' AND NOT starts_with(lower(a), substr(lower(c), 1, 4)) AS translated, 'query: ' || a AS prefixed FROM (SELECT doc_id, {_SPOKEN} AS a, {_WRITTEN} AS c FROM documents)")
def answer_languages(spark: SparkSession, d: str) -> DataFrame:
    """Which questions need a translation to be asked, and how they are put to a model of the e5 family."""
    q = read(spark, d, "documents").select("doc_id", F.expr(_SPOKEN).alias("a"), F.expr(_WRITTEN).alias("c"))
    return q.select("doc_id", search.cross_lingual(F.col("a"), F.col("c")).alias("translated"), providers.with_prefix(F.col("a"), "multilingual-e5-small", "query").alias("prefixed"))


_LIMITED = "concat(text, CASE turn % 5 WHEN 0 THEN ' Please try again in 7.66s.' WHEN 1 THEN ' retry in 2m' WHEN 2 THEN ' after 120ms' WHEN 3 THEN ' no time given' ELSE ' in 1m30s' END)"


@query(rf"""WITH t AS (SELECT conv_id, turn, regexp_replace({_LIMITED}, '[0-9.]+(?:[^0-9.ms]|$)', ' ', 'g') AS t FROM conversations),
    r AS (SELECT conv_id, turn, TRY_CAST(regexp_extract(t, '([\d.]+)(ms|m|s)', 1) AS DOUBLE) AS n, regexp_extract(t, '([\d.]+)(ms|m|s)', 2) AS u FROM t)
    SELECT conv_id, turn, round(CASE u WHEN 'ms' THEN n / 1000 WHEN 'm' THEN n * 60 WHEN 's' THEN n END, 6) AS wait_s FROM r""")
def retry_waits(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace(F.expr(_LIMITED), r"[0-9.]+(?:[^0-9.ms]|$)", " ").alias("t"))
    return t.select("conv_id", "turn", F.round(T.retry_after(F.col("t")), 6).alias("wait_s"))


@query("SELECT url, count(*) AS pages FROM (SELECT trim(url) AS url FROM pages WHERE url IS NOT NULL) GROUP BY url")
def sitemap_urls(spark: SparkSession, d: str) -> DataFrame:
    """The pages' urls written as sitemap files of 1,000 each and read from them again."""
    path = f"{shared_dir(spark)}/sitemap-{uuid.uuid4().hex}"
    u = F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    each = F.concat(F.lit("<url><loc> "), u, F.lit(" </loc><lastmod>2024-01-01</lastmod></url>"))
    at = F.monotonically_increasing_id()
    files = read(spark, d, "pages").filter("url IS NOT NULL").select(F.floor(at / 1000).alias("file"), each.alias("x")).groupBy("file").agg(F.array_join(F.collect_list("x"), "\n").alias("x"))
    files.select(F.concat(F.lit("<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>\n"), "x", F.lit("\n</urlset>"))).write.option("maxRecordsPerFile", 1).text(path)
    return web.sitemap(spark, path).groupBy("url").agg(F.count(F.lit(1)).alias("pages"))


@query(rf"""WITH RECURSIVE {_CUT_SECTIONS} SELECT source, CAST(min(wc) AS INTEGER) AS least, CAST(list_sort(list(wc))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS INTEGER) AS upper_median, CAST(max(wc) AS INTEGER) AS most,
    count(*) AS chunks, round(avg(CASE WHEN h1 IS NOT NULL OR h2 IS NOT NULL THEN 1 ELSE 0 END), 4) AS with_path FROM z WHERE wc >= 25 GROUP BY source""")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the chunks of each source, and what share lies under a heading."""
    c = chunk.chunks(_headed(spark, d), "doc_id", "title", "body").join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return reports.chunk_sizes(c, ["source"], "word_count", F.col("heading_path")).select("source", "least", "upper_median", "most", "chunks", "with_path")


@query("SELECT doc_id, printf('kb_%s_%03d', replace(source, 'src', 'part_'), row_number() OVER (ORDER BY doc_id)) AS record_id, replace(source, 'src', 'part ') || ' / website section' AS source FROM documents")
def record_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.regexp_replace("source", "src", "part_").alias("category"))
    return clean.record_ids(docs, "category", "doc_id").select("doc_id", "record_id", "source")


def _sql(spark: SparkSession, text: str, **views: DataFrame) -> DataFrame:
    """A query in SQL with the library's table functions over views of their own names."""
    tables.register(spark)
    for name, df in views.items():
        own = f"{name}_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(own)
        text = text.replace("{" + name + "}", own)
    return spark.sql(text)


@query(ORACLES["heading_sections"])
def sections_by_sql(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, "SELECT r.doc_id, s.section, array_join(s.heading_path, ' > ') AS path, md5(s.content) AS content_md5 FROM {r} r, LATERAL heading_sections(r.body) s", r=_headed(spark, d))


@query(ORACLES["chunk_records"])
def chunks_by_sql(spark: SparkSession, d: str) -> DataFrame:
    """The whole chunking as SQL with table functions; numbering takes a window by document there."""
    words = r"size(regexp_extract_all({0}, '[^\\s]+', 0))"
    pieces = f"""SELECT r.doc_id, r.title, s.section, s.heading_path, 0 AS piece, s.content FROM {{r}} r, LATERAL heading_sections(r.body) s WHERE {words.format('s.content')} <= {chunk.MAX}
        UNION ALL SELECT r.doc_id, r.title, s.section, s.heading_path, p.piece, trim(BOTH ' \\t\\n\\r' FROM p.content) FROM {{r}} r, LATERAL heading_sections(r.body) s, LATERAL split_long(s.content) p WHERE {words.format('s.content')} > {chunk.MAX}"""
    kept = f"SELECT *, {words.format('content')} AS word_count FROM ({pieces}) WHERE {words.format('content')} >= {chunk.MIN}"
    numbered = f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section, piece) - 1 AS chunk_index FROM ({kept})"
    redacted = r"rlike(content, '\\[[A-Z_]+_REDACTED\\]')"
    out = f"SELECT doc_id, chunk_index, format_string('%s_c%02d', doc_id, chunk_index) AS chunk_id, coalesce(try_element_at(heading_path, -1), title) AS heading, word_count, {redacted} AS pii, md5(content) AS content_md5 FROM ({numbered})"
    return _sql(spark, out, r=_headed(spark, d))


@query("SELECT source, CAST(list_sort(list(n))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS DOUBLE) AS upper_median FROM (SELECT source, length(text) AS n FROM documents) GROUP BY source")
def medians_by_sql(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, "SELECT source, upper_median(CAST(length(text) AS DOUBLE)) AS upper_median FROM {t} GROUP BY source", t=read(spark, d, "documents"))


@query(ORACLES["vad_segments"])
def segments_by_sql(spark: SparkSession, d: str) -> DataFrame:
    """Speech segments of each user's levels in SQL; a channel's levels are one array, frame by frame."""
    rows = "SELECT CAST(user_id AS STRING) AS call, transform(array_sort(collect_list(struct(event_id, value * 20 AS v))), x -> x.v) AS levels FROM {e} GROUP BY user_id"
    out = f"SELECT call, 'caller' AS speaker, concat('c', s.segment) AS utt_id, round(s.first_frame * 0.1D, 2) AS start_s, round(s.end_frame * 0.1D, 2) AS end_s FROM ({rows}), LATERAL speech_segments(levels, 180.0D, 0.1D) s"
    return _sql(spark, out, e=read(spark, d, "events"))


@query("""WITH w AS (SELECT event_id AS key, event_type, user_id % 3 AS hint, value / 100 AS wer, json_extract_string(props, '$.k') AS spoken FROM events),
    a AS (SELECT row_number() OVER (ORDER BY event_type) AS n, '| ' || event_type || ' | ' || printf('%.3f', avg(wer)) || ' | ' || count(*) || ' |' AS line FROM w GROUP BY event_type),
    b AS (SELECT row_number() OVER (ORDER BY event_type, hint) AS n, '| ' || event_type || ' | ' || hint || ' | ' || printf('%.3f', avg(wer)) || ' | ' || count(*) || ' |' AS line FROM w GROUP BY event_type, hint),
    c AS (SELECT row_number() OVER (ORDER BY wer DESC, key) AS n, '| ' || key || ' | ' || printf('%.2f', wer) || ' | ' || coalesce(spoken, '') || ' | ' || event_type || ' |' AS line FROM w QUALIFY n <= 5)
    SELECT concat_ws(chr(10), '# Transcription errors', '', '## By kind', '', '', '| event_type | Mean WER | Trials |', '|---|---|---|', (SELECT string_agg(line, chr(10) ORDER BY n) FROM a), '', '## By kind and hint', '', '',
      '| event_type | hint | Mean WER | Trials |', '|---|---|---|---|', (SELECT string_agg(line, chr(10) ORDER BY n) FROM b), '', '## Worst trials', '', '', '| Trial | WER | Spoken | Transcribed |', '|---|---|---|---|', (SELECT string_agg(line, chr(10) ORDER BY n) FROM c), '') AS markdown""")
def error_report(spark: SparkSession, d: str) -> DataFrame:
    w = _trials(spark, d).join(read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("spoken")), "event_id")
    trials = w.select(F.col("event_id").alias("key"), "event_type", "hint", "wer", "spoken", F.col("event_type").alias("transcript"))
    return pages.markdown(pages.errors(trials, {"By kind": ["event_type"], "By kind and hint": ["event_type", "hint"]}))


@query(f"""WITH {_BEST}, e AS (SELECT query_id, 'refused at retrieval gate' AS b, top_score, refuse FROM t WHERE top_score < 0.5 UNION ALL SELECT query_id, 'answered', top_score, refuse FROM t WHERE top_score >= 0.5),
    x AS (SELECT row_number() OVER (ORDER BY query_id) AS n, e.*, text FROM e JOIN benchmark ON item_id = query_id)
    SELECT md5(concat_ws(chr(10), '# Retrieval evaluation', '', '## Results', '', '', '| # | Query | Intent | Top score | Retrieval verdict | Agent behaviour | Correct |', '|---|---|---|---|---|---|---|',
      (SELECT string_agg('| ' || n || ' | ' || regexp_replace(replace(text, '|', '\\|'), '\\s*\\n\\s*', ' ', 'g') || CASE WHEN refuse THEN ' *(must refuse)*' ELSE '' END || ' | item | ' || printf('%.3f', top_score) || ' | v | ' || b || ' | ' || CASE WHEN refuse = (top_score < 0.5) THEN 'yes' ELSE 'NO' END || ' |', chr(10) ORDER BY n) FROM x), '',
      '**End to end: ' || (SELECT count(*) FILTER (WHERE refuse = (top_score < 0.5)) || '/' || count(*) FROM x) || ' behaved correctly.**', '', '## Detail', '', '',
      (SELECT string_agg('### ' || n || '. ' || text || chr(10) || chr(10) || '- **Intent**: item' || chr(10) || '- **Retrieved chunk**: none' || chr(10) || '- **Source**: —' || chr(10) || '- **Why it matched**: w' || chr(10) || '- **Retrieval verdict**: v — r'
        || chr(10) || CASE WHEN top_score < 0.5 THEN '- **Agent behaviour**: ' || b ELSE '- **Agent answered**: a' || chr(10) || '- **Citations**: none' END || chr(10), chr(10) ORDER BY n) FROM x), '')) AS markdown_md5""")
def retrieval_report(spark: SparkSession, d: str) -> DataFrame:
    t = _best(spark, d).join(read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "query_id")
    low, none = F.col("top_score") < 0.5, F.lit(None).cast("string")
    rows = t.select(
        F.col("query_id").alias("at"), F.col("text").alias("query"), F.lit("item").alias("intent"), "must_refuse", "top_score", F.lit("v").alias("verdict"), F.lit("r").alias("reason"), low.alias("refused"), F.lit("retrieval").alias("gate"),
        (F.col("must_refuse") == low).alias("right"), none.alias("chunk"), none.alias("url"), F.lit("w").alias("why"), F.lit("a").alias("answer"), F.array().cast("array<string>").alias("citations"), F.lit("").alias("note"), F.lit("").alias("snippet"),
    )
    return pages.markdown(pages.retrieval(rows)).select(F.md5("markdown").alias("markdown_md5"))
