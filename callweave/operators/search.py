"""What is done with a search's results: ranking, gates, variants, citations, verdicts, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions import text as T
from callweave.operators.reports import upper_median

K1, B, EPSILON = 1.5, 0.75, 0.25


def idf(docs: DataFrame, key: str, text: str) -> DataFrame:
    """token, df, idf: ln(N - df + 0.5) - ln(df + 0.5), negative ones replaced by EPSILON times the mean over all."""
    n = docs.agg(F.count(F.lit(1)).alias("__n"))
    df = docs.select(F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    raw = df.crossJoin(F.broadcast(n)).withColumn("raw", F.log(F.col("__n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("__mean"))
    return raw.crossJoin(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") < 0, EPSILON * F.col("__mean")).otherwise(F.col("raw")).alias("idf"))


def saturate[T](raw: T, half: float = 6.0) -> T:
    """A BM25 sum (a column or an array) on a scale from 0 to 1."""
    return raw / (raw + half)


def top_k(scored: DataFrame, key: str, k: int = 8, score: str = "score", category: Column | None = None) -> DataFrame:
    """Rows with rank 1..k a query, best score first, ties to the smaller key; the category filter goes first."""
    rows = scored if category is None else scored.filter(category)
    w = Window.partitionBy("query_id").orderBy(F.desc(score), key)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def gate(ranked: DataFrame, least: float = 0.5, score: str = "score") -> DataFrame:
    """query_id, top_score, answerable."""
    return ranked.groupBy("query_id").agg(F.max(score).alias("top_score")).withColumn("answerable", F.col("top_score") >= least)


def merge_variants(variants: list[DataFrame], key: str, k: int = 8) -> DataFrame:
    """Best score of each key over the variants of a query, the earlier variant on a tie, ranked again."""
    union = None
    for i, v in enumerate(variants):
        part = v.select("query_id", key, "score").withColumn("variant", F.lit(i))
        union = part if union is None else union.unionByName(part)
    best = union.groupBy("query_id", key).agg(F.max(F.struct("score", (-F.col("variant")).alias("v"))).alias("b"))
    return top_k(best.select("query_id", key, F.col("b.score").alias("score"), (-F.col("b.v")).alias("variant")), key, k)


def explain(vector: Column, lexical: Column) -> Column:
    v = F.when(vector >= 0.5, "strong semantic match").when(vector >= 0.3, "moderate semantic match").otherwise("weak semantic match")
    b = F.when(lexical >= 0.5, "strong keyword overlap").when(lexical >= 0.2, "some keyword overlap").otherwise("little keyword overlap")
    return F.format_string("%s (%.2f); %s (%.2f)", v, vector, b, lexical)


def citation_label(title: Column, path: Column, url: Column | None = None) -> Column:
    label = F.concat(title, F.lit(" — "), F.coalesce(F.nullif(F.array_join(path, " > "), F.lit("")), title))
    return label if url is None else F.concat(label, F.lit(" ("), url, F.lit(")"))


def validate_citations(stated: Column, retrieved: Column) -> tuple[Column, Column]:
    """(valid, invalid) stated identifiers, in stated order."""
    return F.array_intersect(stated, retrieved), F.array_except(stated, retrieved)


def answer_sources(results: DataFrame, cited: str, key: str, url: str) -> DataFrame:
    """First row (by rank) of each page among the cited results; among all, if none is cited."""
    any_cited = F.max(F.col(cited).cast("int")).over(Window.partitionBy("query_id"))
    use = results.withColumn("__any", any_cited).filter((F.col("__any") == 0) | F.col(cited))
    w = Window.partitionBy("query_id", url).orderBy("rank")
    return use.withColumn("__r", F.row_number().over(w)).filter("__r = 1").select("query_id", url, key, "rank")


def context_block(ranked: DataFrame, key: str, text: str) -> DataFrame:
    """query_id, context: passages in rank order, each behind its identifier."""
    part = F.struct("rank", F.concat(F.lit("["), F.col(key).cast("string"), F.lit("] "), F.col(text)).alias("t"))
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n").alias("context"))


def cross_lingual(answer: Column, corpus: Column) -> Column:
    """Is a translated variant needed: the answer's language doesn't start with the corpus language's first 4 letters."""
    return (answer != "") & ~F.startswith(F.lower(answer), F.substring(F.lower(corpus), 1, 4))


def verdict(must_refuse: Column, expected: Column, top_score: Column, categories: Column, least: float = 0.5) -> Column:
    """correct, partially correct or incorrect, from the ranked categories of a query's results."""
    at = F.array_position(categories, expected)
    none = F.size(categories) == 0
    return (
        F.when(none, F.when(must_refuse, "correct").otherwise("incorrect")).when(must_refuse, F.when(top_score < least, "correct").otherwise("incorrect"))
        .when(expected.isNull(), F.when(top_score >= least, "partially correct").otherwise("incorrect")).when(at == 1, "correct").when(at > 1, "partially correct").otherwise("incorrect")
    )


def calibrate(scores: DataFrame, by: list[str], score: str = "top_score", refuse: str = "must_refuse") -> DataFrame:
    """Score bands that part answerable from unanswerable queries of each group, rounded half-even to 3 places."""
    good, bad = F.when(~F.col(refuse), F.col(score)), F.when(F.col(refuse), F.col(score))
    g = scores.groupBy(*by).agg(F.min(good).alias("lo"), F.max(bad).alias("hi"), F.percentile(good, 0.5).alias("mid"))
    g = g.join(upper_median(scores.filter(~F.col(refuse)), by, score).withColumnRenamed("upper_median", "upper"), by, "left")
    return g.select(*by, F.bround("lo", 3).alias("answerable_min"), F.bround("upper", 3).alias("answerable_median"), F.bround("mid", 3).alias("answerable_mid"), F.bround("hi", 3).alias("unanswerable_max"), (F.col("lo") > F.col("hi")).alias("separable"), F.bround((F.col("lo") + F.col("hi")) / 2, 3).alias("suggested_threshold"), F.bround(F.greatest(F.lit(0.05), F.col("lo") - 0.03), 3).alias("gate"))


def gate_lists(scores: DataFrame, gates: DataFrame, by: list[str], key: str, score: str = "top_score", refuse: str = "must_refuse") -> DataFrame:
    """key, by, fate of the queries that calibrate()'s gate gets wrong: answerable ones it would refuse, and unanswerable
    ones it would answer. A row each, so that a list of any length is one."""
    j = scores.join(gates.select(*by, "gate"), by)
    fate = F.when(~F.col(refuse) & (F.col(score) < F.col("gate")), "would be refused").when(F.col(refuse) & (F.col(score) >= F.col("gate")), "would be answered")
    return j.select(*by, key, fate.alias("fate")).filter("fate IS NOT NULL")
