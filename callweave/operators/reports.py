"""Reports over corpora, trials, calls and models, and the small projections beside them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def counts(rows: DataFrame, *by: str) -> DataFrame:
    """by, n, place: group sizes, the largest first, ties by the group's values."""
    w = Window.orderBy(F.desc("n"), *by)  # a row a group
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.row_number().over(w))


def upper_median(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, upper_median: sorted[n // 2] of each group, nulls left out. Values are counted first, so a group of any size
    comes down to its distinct values, of which the one that holds the middle place is found by running sums."""
    n = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*by)
    before = F.sum("__n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    at = n.withColumn("__b", before).withColumn("__m", F.floor(F.sum("__n").over(w) / 2))
    return at.filter((F.col("__b") <= F.col("__m")) & (F.col("__m") < F.col("__b") + F.col("__n"))).select(*by, F.col(value).alias("upper_median"))


def chunk_sizes(chunks: DataFrame, by: Sequence[str], size: str, path: Column) -> DataFrame:
    """by, chunks, least, upper_median, most, with_path: sizes, and the share of chunks that have a heading path."""
    g = chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("chunks"), F.min(size).alias("least"), F.max(size).alias("most"), F.round(F.avg((F.coalesce(F.size(path), F.lit(0)) > 0).cast("int")), 4).alias("with_path"))
    return g.join(upper_median(chunks, by, size), list(by), "left")


def corpus_overview(corpora: DataFrame, steps: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """key, and for each corpus what is known of it, nulls where nothing is: its chunks and their mean words, and its
    funnel as `name=count` in order of steps (key, step, name, n)."""
    line = F.struct("step", F.concat("name", F.lit("="), F.col("n").cast("string")).alias("l"))
    funnel = steps.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), " > ").alias("funnel"))
    sizes = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg("words"), 2).alias("mean_words"))
    return corpora.join(sizes, key, "left").join(funnel, key, "left")


def funnel_shares(steps: DataFrame, by: str, order: str, n: str) -> DataFrame:
    """steps with `share` of the first step's count."""
    first = F.first(n).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("share", F.when(first > 0, F.round(F.col(n) / first, 4)))


def display_scale(scores: DataFrame, by: str, score: str, threshold: float) -> DataFrame:
    """by, scale: the width that a chart of scores needs, so that the threshold and the best score are inside."""
    return scores.groupBy(by).agg(F.greatest(F.lit(threshold * 1.6), F.max(score), F.lit(0.2)).alias("scale"))


def first_market(corpora: DataFrame, markets: DataFrame, corpus: str, market: str) -> DataFrame:
    """Each corpus with the first market, by name, that reads it; null if none does."""
    return corpora.join(markets.groupBy(corpus).agg(F.min(market).alias(market)), corpus, "left")


def trials(*parts: DataFrame) -> DataFrame:
    """Every combination of small configuration tables (voices, hints, sentences): a test matrix, whose size is the
    product of theirs. Tables of over 10,000 rows are refused."""
    out = None
    for p in parts:
        if p.limit(10_001).count() > 10_000:
            raise ValueError("a test matrix is made of configuration tables")
        out = p if out is None else out.crossJoin(F.broadcast(p))
    return out


def error_rates(scored: DataFrame, wer: str, *groupings: Sequence[str]) -> DataFrame:
    """grouping, group, trials, mean_wer (half-even, 3 places): means of each grouping's groups, in one pass."""
    name = lambda g: F.struct(F.lit(" x ".join(g)).alias("grouping"), F.concat_ws(" / ", *[F.col(c).cast("string") for c in g]).alias("group"))
    each = scored.select(F.explode(F.array(*[name(g) for g in groupings])).alias("g"), wer)
    return each.groupBy("g.grouping", "g.group").agg(F.count(F.lit(1)).alias("trials"), F.bround(F.avg(wer), 3).alias("mean_wer"))


def worst(scored: DataFrame, wer: str, key: str, k: int = 5) -> DataFrame:
    """The k trials with the highest rates, ties by key."""
    return scored.orderBy(F.desc(wer), key).limit(k)


def worse_by(rates: DataFrame, group: str, over: str) -> DataFrame:
    """ratio: the mean rate of one group of error_rates() over another's, two places; null where a group is missing."""
    pick = lambda g: F.max(F.when(F.col("group") == g, F.col("mean_wer")))
    return rates.agg(F.when(pick(over) > 0, F.bround(pick(group) / pick(over), 2)).alias("ratio"))


def capabilities(outputs: DataFrame, model: str, output: str, refusal: str) -> DataFrame:
    """model, runs, json, refused, failed: how many outputs begin as a JSON object, hold the refusal token, are errors."""
    o = F.trim(F.coalesce(output, F.lit("")))
    return outputs.groupBy(model).agg(F.count(F.lit(1)).alias("runs"), F.count_if(o.startswith("{")).alias("json"), F.count_if(o.contains(refusal)).alias("refused"), F.count_if(o.startswith("FAILED:")).alias("failed"))


def literals(sources: DataFrame, name: str, source: str, pattern: str = r"\"([^\"\n]{12,})\"") -> DataFrame:
    """name, literal: the string literals of program sources that are long enough to be spoken."""
    return sources.select(name, F.explode(F.array_distinct(F.regexp_extract_all(source, F.lit(pattern), F.lit(1)))).alias("literal"))


def score_parts(ranked: DataFrame, cited: Column, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """ranked with what each side gives to the score, rounded half-even, and whether the row was cited."""
    part = lambda c, w: F.bround(F.col(c) * w, 4)
    return ranked.withColumn("vector_part", part("vector_score", weights[0])).withColumn("bm25_part", part("bm25_score", weights[1])).withColumn("cited", cited)


def iso_time(ts: Column) -> Column:
    """UTC with microseconds and offset, in a session whose time zone is UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def sample_range(samples: Column, start_s: Column, end_s: Column, rate: int, before_s: float = 0.2, after_s: float = 0.2) -> Column:
    """The samples from start to end with some before and after, as far as there are any."""
    lo = F.greatest(F.lit(0), F.floor((start_s - before_s) * rate).cast("int"))
    hi = F.least(F.size(samples), F.floor((end_s + after_s) * rate).cast("int"))
    return F.slice(samples, lo + 1, F.greatest(hi - lo, F.lit(0)))


def merged_spans(*recorders: DataFrame) -> DataFrame:
    """The spans of several recorders (stage, ms, seq) as one, in order of recorder and place."""
    out = None
    for i, r in enumerate(recorders):
        part = r.select("stage", "ms", (F.lit(i).cast("long") * (1 << 40) + F.col("seq")).alias("seq"))
        out = part if out is None else out.unionByName(part)
    return out


def write_spans(spans: DataFrame, summary: DataFrame, path: str) -> None:
    """Raw spans and their summary, side by side."""
    spans.write.mode("overwrite").parquet(f"{path}/raw_spans")
    summary.write.mode("overwrite").json(f"{path}/summary")


def without(rows: DataFrame, broken: DataFrame, key: str) -> DataFrame:
    """rows that aren't among broken."""
    return rows.join(broken.select(key).distinct(), key, "left_anti")


def scenarios(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Scenario files (a JSON object each) of a folder, by `id`; one by name, which may only be a name."""
    got = spark.read.option("multiLine", True).json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    if name is None:
        return got
    return got.filter(F.col("id") == name) if all(c.isalnum() or c in "_-" for c in name) and name else got.limit(0)


def markets(spark: SparkSession, path: str) -> DataFrame:
    """market, fields: the scalar top-level fields of each market's YAML file, by file name; nested ones are left out."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.ya?ml$", 1).alias("market"), F.col("value").alias("t")).filter("market <> ''")
    line = F.filter(F.split("t", "\r?\n"), lambda x: x.rlike(r"^[A-Za-z_]\w*:[ \t]+[^ \t|>&*#\[{]"))
    pair = F.transform(line, lambda x: F.struct(F.regexp_extract(x, r"^(\w+):", 1).alias("k"), F.regexp_replace(F.regexp_extract(x, r"^\w+:[ \t]+(.*?)[ \t]*$", 1), "^(['\"])(.*)\\1$", "$2").alias("v")))
    return files.select("market", F.map_from_entries(pair).alias("fields"))
