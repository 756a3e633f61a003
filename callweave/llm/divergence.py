"""Source divergence audit: how far each source's term frequencies are from its language's other sources, and by which terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.common import stage

#: A term is kept in a language if so many of its documents have it.
LEAST_DOCS = 3
#: Ranks of the term report.
TOP_TERMS = 200
#: Frequencies are integers out of so many.
UNIT = 1_000_000_000
#: Distinct (language, source, term) counts that a task holds before it sends them on.
HELD = 400_000
#: Groups up to which their totals are broadcast; more are joined by shuffle.
SENT_GROUPS = 100_000

#: Bytes of terms stay, A-Z lowered: letters and every byte beyond ASCII; all others part terms.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents): partial sums, a row or more for each. Null columns count as
    ''. Counts are summed in the task that reads the texts, at most HELD of them at once, so that a frequent term of a
    large source is a row a task."""
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])

    def out(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in held.items():
            for some in batched(n, 50_000):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array([t.decode() for t in some], pa.string()), pa.array(list(map(n.__getitem__, some)), pa.int64()), pa.array(list(map(df.__getitem__, some)), pa.int64())], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for b in batches:
            langs, sources = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang, source, text in zip(langs, sources, b.column(2), strict=True):
                if (lang, source) not in held:
                    held[lang, source] = Counter(), Counter()
                    size += 1
                n, df = held[lang, source]
                before = len(n)
                terms = text.as_py().encode().translate(_BYTES).split()
                n.update(terms)
                df.update(set(terms))
                size += len(n) - before
                if size >= HELD:
                    yield from out(held)
                    held, size = {}, 0
        yield from out(held)

    return docs.select(*map(_blank, ("lang", "source", "text"))).mapInArrow(run, "lang string, source string, term string, n long, df long")


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + v)), exactly: the product has 38 digits' room."""
    wide = lambda c: c.cast("decimal(28,0)")
    return F.lit(1).cast("long") + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * wide(n + 1), wide(total + v))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)² / q); p and q are at most UNIT + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: for each group (lang, source), part `pair` ranks the language's other
    sources by their divergence from it, part `term` the terms that it uses more than its language does.

    Terms are counted in the tasks that read them, then put together into one sparse vector of counts by source for each
    (lang, term). Terms with equal vectors count alike for every pair of sources, so a pair is evaluated once a distinct
    vector and weighed by the number of its terms. Of S sources a vector with k of them gives k (k - 1) pairs; what a
    source adds where the other has nothing depends on its count alone, and is evaluated once a distinct count. All sums
    are integers. Terms are ranked by themselves, in groups cut to `top_terms` before they are shuffled.

    Null text, lang and source count as ''. A group without terms still has its pairs, with value 0 if its language keeps
    no term; a language with one source has no pairs; repeated rows count each; no rows give no rows; other columns don't
    matter."""
    # dealt by term, so that sums by source and by language share one shuffle
    by_source = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    vector = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector")
    kept = by_source.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"), vector).filter(F.col("df") >= least_docs).select("lang", "term", "n", "vector")
    kept = stage(kept, "kept-terms")

    distinct = kept.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("terms")).select(F.monotonically_increasing_id().alias("id"), "lang", "vector", "terms")
    distinct = stage(distinct, "count-vectors")
    entries = distinct.select("id", "lang", "terms", F.explode("vector").alias("e")).select("id", "lang", "terms", "e.source", "e.n")
    totals = entries.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("total"), F.sum("terms").alias("has"))
    words = distinct.groupBy("lang").agg(F.sum("terms").alias("v"))
    seen = docs.select(_blank("lang"), _blank("source")).distinct()
    groups = seen.join(totals, ["lang", "source"], "left").join(words, "lang", "left").na.fill(0, ["total", "has", "v"])
    groups = stage(groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v")))), "groups")
    sent = (lambda d: F.broadcast(d)) if groups.count() <= SENT_GROUPS else (lambda d: d)

    # every entry's own share, once a distinct count of a source
    counts = entries.groupBy("lang", "source", "n").agg(F.sum("terms").alias("terms")).join(sent(groups), ["lang", "source"])
    counts = counts.select("lang", "source", "n", "terms", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "p0")
    counts = stage(counts, "counts")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("has").alias("item_has"))
    pairs = groups.filter("v > 0").select("lang", "source", "p0", "has", "v").join(sent(other), "lang").filter("source <> item")
    far = counts.select("lang", "source", "p", "terms").join(sent(other), "lang").filter("source <> item")
    one = far.groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * gap(F.col("p"), F.col("q0"))).alias("value"))
    mine = groups.filter("v > 0").select("lang", "source", "p0")
    near = counts.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), "terms").join(sent(mine), "lang").filter("source <> item")
    two = near.groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * gap(F.col("p0"), F.col("q"))).alias("value"))
    # vectors that hold both: what the two sums above took for one-sided is put right
    wide = entries.join(counts.drop("terms"), ["lang", "source", "n"]).select("id", "lang", "terms", F.struct("source", "p", "p0").alias("e"))
    held = wide.groupBy("id", "lang", "terms").agg(F.collect_list("e").alias("es")).filter(F.size("es") > 1)
    both = held.select("lang", "terms", F.explode("es").alias("a"), "es").select("lang", "terms", "a", F.explode("es").alias("b")).filter("a.source <> b.source")
    over = gap(F.col("a.p"), F.col("b.p")) - gap(F.col("a.p"), F.col("b.p0")) - gap(F.col("a.p0"), F.col("b.p"))
    three = both.groupBy("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item")).agg(F.sum(F.col("terms") * over).alias("value"), F.sum("terms").alias("common"))
    zero = F.lit(0).cast("long")
    sums = one.withColumn("common", zero).unionByName(two.withColumn("common", zero)).unionByName(three)
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("common").alias("common"))
    none = F.col("v") - F.col("has") - F.col("item_has") + F.coalesce("common", zero)
    value = F.coalesce("value", zero) + none * gap(F.col("p0"), F.col("q0"))
    bare = groups.filter("v = 0").select("lang", "source").join(sent(other.select("lang", "item")), "lang").filter("source <> item").withColumn("value", zero)
    pair = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", "item", value.alias("value")).unionByName(bare)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    whole = totals.groupBy("lang").agg(F.sum("total").alias("whole"))
    size = sent(groups.filter("v > 0").select("lang", "source", "total", "v").join(whole, "lang"))
    each = kept.select("lang", "term", F.col("n").alias("all"), F.explode("vector").alias("e")).select("lang", "term", "all", "e.source", "e.n").join(size, ["lang", "source"])
    each = each.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("all"), F.col("whole"), F.col("v")).alias("q"))
    each = each.filter("p > q").select("lang", "source", "item", gap(F.col("p"), F.col("q")).alias("value"))
    term = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)
    return pair.unionByName(term.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
