"""Reports as Markdown: tables, details and lists over result tables, put together to a page and written as one file.

A part is a table (at, line): the lines of a section in order. Parts stay tables until a page is written, so a part may
be as long as its rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def _fixed(c: Column | str, places: int) -> Column:
    """A number with so many places; null stays."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.format_string(f"%.{places}f", c.cast("double")))


def _numbered(rows: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """rows with __n, from 1: a report's rows are few enough to be counted in one task."""
    return rows.withColumn("__n", F.row_number().over(Window.orderBy(*order)))


def heading(spark: SparkSession, *lines: str) -> DataFrame:
    """Fixed lines."""
    return spark.createDataFrame([([0, k], x) for k, x in enumerate(lines)], "at array<long>, line string")


def table(rows: DataFrame, columns: Mapping[str, Column | str], order: Sequence[Column | str], numbered: bool = False) -> DataFrame:
    """A table with these columns by heading; cells' bars and line feeds are escaped, null is empty. With `numbered` the
    first column counts the rows. Without rows the head stays."""
    cell = lambda c: F.regexp_replace(F.replace(_text(c), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")
    cells = [F.col("__n").cast("string")] * numbered + [cell(c) for c in columns.values()]
    names = ["#"] * numbered + list(columns)
    body = _numbered(rows, order).select(F.array(F.lit(1), F.col("__n")).cast("array<long>").alias("at"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    return heading(rows.sparkSession, "| " + " | ".join(names) + " |", "|" + "---|" * len(names)).unionByName(body)


def details(rows: DataFrame, title: Column | str, fields: Mapping[str, Column | str], order: Sequence[Column | str], quote: Column | str | None = None, level: int = 3) -> DataFrame:
    """For each row a numbered heading, a line for each field that isn't null, and the quoted text, if there is any, in a
    fence."""
    some = [F.when((F.col(c) if isinstance(c, str) else c).isNotNull(), F.concat(F.lit(f"- **{label}**: "), _text(c))) for label, c in fields.items()]
    lines = [F.concat(F.lit("#" * level + " "), F.col("__n").cast("string"), F.lit(". "), _text(title)), F.lit(""), *some, F.lit("")]
    if quote is not None:
        q = F.replace(_text(quote), F.lit("```"), F.lit(""))
        lines[-1:] = [F.when(q != "", x) for x in (F.lit(""), F.lit("```"), q, F.lit("```"))] + [F.lit("")]
    each = _numbered(rows, order).select("__n", F.posexplode(F.filter(F.array(*lines), lambda x: x.isNotNull())).alias("k", "line"))
    return each.select(F.array("__n", "k").cast("array<long>").alias("at"), "line")


def page(*parts: DataFrame) -> DataFrame:
    """at, line of all parts, a blank line between them."""
    blank = lambda p: heading(p.sparkSession, "").select(F.array(F.lit(1 << 60)).cast("array<long>").alias("at"), "line")
    put = lambda i, p: p.unionByName(blank(p)).select(F.concat(F.array(F.lit(i).cast("long")), "at").alias("at"), "line")
    return reduce(DataFrame.unionByName, [put(i, p) for i, p in enumerate(parts)])


def markdown(whole: DataFrame) -> DataFrame:
    """One row, `markdown`: a page's text."""
    return whole.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("markdown"))


def write(whole: DataFrame, path: str) -> None:
    """The page as one text file in the folder path, which is written over."""
    whole.orderBy("at").coalesce(1).select("line").write.mode("overwrite").text(path)


def share(good: Column, of: Column) -> Column:
    return F.concat(good.cast("string"), F.lit("/"), of.cast("string"))


def _yes(c: Column | str) -> Column:
    return F.when(F.col(c) if isinstance(c, str) else c, "yes").otherwise("no")


def retrieval(rows: DataFrame, calibration: DataFrame | None = None) -> DataFrame:
    """The retrieval evaluation: a table of all questions, how many went right, each in detail, and the score bands. rows:
    at, query, intent, must_refuse, top_score, verdict, reason, refused, gate, right, chunk, url, why, answer, citations,
    note, snippet; calibration: as search.calibrate has it, one row."""
    spark = rows.sparkSession
    behaviour = F.when(F.col("refused"), F.concat(F.lit("refused at "), "gate", F.lit(" gate"))).otherwise("answered")
    question = F.concat("query", F.when(F.col("must_refuse"), " *(must refuse)*").otherwise(""))
    shown = {"Query": question, "Intent": "intent", "Top score": _fixed("top_score", 3), "Retrieval verdict": "verdict", "Agent behaviour": behaviour, "Correct": F.when(F.col("right"), "yes").otherwise("NO")}
    right = rows.agg(share(F.count_if("right"), F.count(F.lit(1))).alias("n"))
    total = right.select(F.array(F.lit(0)).cast("array<long>").alias("at"), F.concat(F.lit("**End to end: "), "n", F.lit(" behaved correctly.**")).alias("line"))
    fields = {
        "Intent": "intent", "Retrieved chunk": F.coalesce("chunk", F.lit("none")), "Source": F.coalesce("url", F.lit("—")), "Why it matched": "why", "Retrieval verdict": F.concat_ws(" — ", "verdict", "reason"),
        "Agent behaviour": F.when(F.col("refused"), behaviour), "Agent answered": F.when(~F.col("refused"), F.col("answer")), "Citations": F.when(~F.col("refused"), F.coalesce(F.nullif(F.array_join("citations", ", "), F.lit("")), F.lit("none"))), "Note": F.nullif("note", F.lit("")),
    }
    parts = [heading(spark, "# Retrieval evaluation", "", "## Results", ""), table(rows, shown, ["at"], numbered=True), total, heading(spark, "## Detail", ""), details(rows, "query", fields, ["at"], "snippet")]
    if calibration is not None:
        names = {"answerable_min": "Lowest top score of answerable questions", "answerable_median": "Median of answerable questions", "unanswerable_max": "Highest top score of others", "suggested_threshold": "Threshold between them"}
        each = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(label).alias("measure"), _text(c).alias("score")) for k, (c, label) in enumerate(names.items())], F.struct(F.lit(len(names)).alias("k"), F.lit("Separable by score alone").alias("measure"), _yes("separable").alias("score")))
        bands = calibration.select(F.explode(each).alias("b")).select("b.*")
        parts += [heading(spark, "## Threshold calibration", ""), table(bands, {"Measure": "measure", "Score": "score"}, ["k"])]
    return page(*parts)


def errors(trials: DataFrame, groupings: Mapping[str, Sequence[str]], worst: int = 5) -> DataFrame:
    """Word errors: a table of means for each grouping, and the worst trials (key, wer, spoken, transcript)."""
    spark, parts = trials.sparkSession, [heading(trials.sparkSession, "# Transcription errors")]
    for title, by in groupings.items():
        means = trials.groupBy(*by).agg(_fixed(F.avg("wer"), 3).alias("__wer"), F.count(F.lit(1)).alias("__trials"))
        parts += [heading(spark, f"## {title}", ""), table(means, {**{c: c for c in by}, "Mean WER": "__wer", "Trials": "__trials"}, by)]
    top = trials.orderBy(F.desc("wer"), "key").limit(worst)
    shown = {"Trial": "key", "WER": _fixed("wer", 2), "Spoken": F.substring("spoken", 1, 56), "Transcribed": F.substring("transcript", 1, 56)}
    return page(*parts, heading(spark, "## Worst trials", ""), table(top, shown, [F.desc("wer"), "key"]))


def models(latency: DataFrame, checks: DataFrame) -> DataFrame:
    """Models compared: latency (model, mean, least, most, place, speedup, as calls.ranked_latency has it), then what each
    can do (as reports.capabilities has it), and the fastest."""
    spark, ms = latency.sparkSession, lambda c: F.concat(_fixed(c, 1), F.lit(" ms"))
    best = latency.filter("place = 1").select(F.array(F.lit(0)).cast("array<long>").alias("at"), F.concat(F.lit("Fastest: `"), "model", F.lit("`"), F.coalesce(F.concat(F.lit(", "), _fixed("speedup", 1), F.lit(" times as fast as the next")), F.lit("")), F.lit(".")).alias("line"))
    able = {"Model": "model", "JSON": share(F.col("json"), F.col("runs")), "Refused": share(F.col("refused"), F.col("runs")), "Failed": share(F.col("failed"), F.col("runs"))}
    return page(
        heading(spark, "# Model selection", "", "## Latency", ""), table(latency, {"Model": "model", "Mean": ms("mean"), "Min": ms("least"), "Max": ms("most")}, ["place"]), best,
        heading(spark, "## Capabilities", ""), table(checks, able, ["model"]),
    )


def call_results(results: DataFrame) -> DataFrame:
    """Test calls: a table, then each with its transcript. results: at, name, why, call_id, final_state, slots_filled,
    grounded_answers, refusals, escalated, band, score, transcript."""
    spark = results.sparkSession
    shown = {"Scenario": "name", "Final state": "final_state", "Slots": "slots_filled", "Grounded": "grounded_answers", "Refusals": "refusals", "Escalated": _yes("escalated")}
    lead = F.when(F.col("band").isNotNull(), F.concat("band", F.lit(" (score "), _text("score"), F.lit(")")))
    fields = {"Why": "why", "Call": "call_id", "Lead": lead, "Handover": F.when(F.col("escalated"), "escalation written")}
    return page(heading(spark, "# Test calls", ""), table(results, shown, ["at"], numbered=True), heading(spark, "## Calls", ""), details(results, "name", fields, ["at"], "transcript"))


def live_results(scenarios: DataFrame, latency: DataFrame) -> DataFrame:
    """Live runs: scenarios (at, id, seen, shown, rate, expected, fired, passed), then latencies by stage (as
    calls.latency_summary has them)."""
    spark = scenarios.sparkSession
    shown = {"Scenario": "id", "Signals": "seen", "Nudges": "shown", "Suppressed": F.concat(F.round(F.col("rate") * 100).cast("int").cast("string"), F.lit(" %")), "Expected": F.array_join("expected", ", "), "Fired": F.array_join("fired", ", "), "Passed": F.when(F.col("passed"), "yes").otherwise("NO")}
    passed = scenarios.agg(share(F.count_if("passed"), F.count(F.lit(1))).alias("n")).select(F.array(F.lit(0)).cast("array<long>").alias("at"), F.concat(F.lit("**"), "n", F.lit(" scenarios passed.**")).alias("line"))
    return page(heading(spark, "# Live runs", ""), table(scenarios, shown, ["at"], numbered=True), passed, heading(spark, "## Latency", ""), latency_table(latency))


def latency_table(latency: DataFrame) -> DataFrame:
    """calls.latency_summary() as a table."""
    return table(latency, {"Stage": "stage", "n": "count", "p50 (ms)": "p50_ms", "p95 (ms)": "p95_ms", "mean (ms)": "mean_ms", "max (ms)": "max_ms"}, ["place"])
