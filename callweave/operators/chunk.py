"""Chunks by heading sections: heading paths, oversize splits with overlap, numbering."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions import text as T

#: Words that a piece aims at, has at most, has at least, and carries over from the one before. Fixed values.
TARGET, MAX, MIN, OVERLAP = 180, 320, 25, 30


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def section_array(body: Column) -> Column:
    """array<struct<path: array<string>, content: string>>: lines between headings `#`..`####`, blank sections dropped. A
    heading closes those of its level and below. Null has none.

    Only headings are folded, and the fold keeps where each stands with its path; every section's lines are taken in one
    slice, so that a record costs as much as its lines, however many there are."""
    mark = "array<struct<at:int,level:int,title:string>>"

    def of(lines: Column) -> Column:
        level = lambda x: F.length(F.regexp_extract(T.strip(x), r"^(#{1,4})\s+\S", 1))
        title = lambda x: T.strip(F.regexp_replace(T.strip(x), r"^#{1,4}\s+", ""))
        heads = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), level(x).alias("level"), x.alias("title"))), lambda h: h["level"] > 0)
        heads = F.transform(heads, lambda h: F.struct(h["at"].alias("at"), h["level"].alias("level"), title(h["title"]).alias("title")))
        zero = F.struct(F.array().cast(mark).alias("stack"), F.array(F.struct(F.lit(-1).alias("at"), F.array().cast("array<string>").alias("path"))).alias("done"))

        def step(a: Column, h: Column) -> Column:
            return _bound(
                F.concat(F.filter(a["stack"], lambda x: x["level"] < h["level"]), F.array(h)).cast(mark),
                lambda stack: F.struct(stack.alias("stack"), F.concat(a["done"], F.array(F.struct(h["at"].alias("at"), F.transform(stack, lambda x: x["title"]).alias("path")))).alias("done")),
            )

        paths = F.aggregate(heads, zero, step, lambda a: a["done"])

        def cut(ps: Column) -> Column:
            following = lambda k: F.coalesce(F.get(ps, k + 1)["at"], F.size(lines))
            content = lambda p, k: T.strip(F.array_join(F.slice(lines, p["at"] + 2, following(k) - p["at"] - 1), "\n"))
            return F.filter(F.transform(ps, lambda p, k: F.struct(p["path"].alias("path"), content(p, k).alias("content"))), lambda p: p["content"] != "")

        return _bound(paths, cut)

    return _bound(F.split(F.coalesce(body, F.lit("")), "\n"), of)


def sections(records: DataFrame, key: str, body: str, keep: Sequence[str] = ()) -> DataFrame:
    """key, the columns of keep, section, heading_path, content of every section of every record, from its own row."""
    s = records.select(key, *keep, F.posexplode(section_array(F.col(body))).alias("section", "p"))
    return s.select(key, *keep, "section", F.col("p.path").alias("heading_path"), F.col("p.content").alias("content"))


def split_long(text: Column, target: int = TARGET, overlap: int = OVERLAP, least: int = MIN) -> Column:
    """array<string>: sentences and lines gathered to `target` words, the last `overlap` words carried over; a single
    unit over target is cut; a last piece under `least` words joins the one before."""
    words = lambda s: F.regexp_extract_all(s, F.lit(r"[^\s]+"), F.lit(0))
    units = F.filter(F.split(text, r"(?<=[.!?])\s+|\n"), lambda u: T.strip(u) != "")
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / target).cast("int")), lambda i: F.array_join(F.slice(w, i * target + 1, target), " "))
    sentences = F.flatten(F.transform(units, lambda u: _bound(words(u), lambda w: F.when(F.size(w) <= target, F.array(u)).otherwise(cut(w)))))
    counted = F.transform(sentences, lambda s: F.struct(s.alias("s"), F.size(words(s)).alias("n")))
    none = F.array().cast("array<string>")
    zero = F.struct(none.alias("done"), none.alias("now"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        s, size = x["s"], x["n"]
        more = F.struct(a["done"].alias("done"), F.concat(a["now"], F.array(s)).alias("now"), (a["n"] + size).alias("n"))
        tail = lambda w: F.slice(w, F.greatest(F.size(w) - (overlap - 1), F.lit(1)), overlap)
        next_ = lambda joined: _bound(tail(words(joined)), lambda t: F.struct(F.concat(a["done"], F.array(joined)).alias("done"), F.array(F.array_join(t, " "), s).alias("now"), (F.size(t) + size).alias("n")))
        full = (a["n"] + size > target) & (F.size(a["now"]) > 0)
        return F.when(full, _bound(F.array_join(a["now"], " "), next_)).otherwise(more)

    def end(a: Column) -> Column:
        piece = F.array_join(a["now"], " ")
        fold = (F.size(a["done"]) > 0) & (F.size(words(piece)) < least)
        folded = F.concat(F.slice(a["done"], 1, F.greatest(F.size(a["done"]) - 1, F.lit(0))), F.array(F.concat(F.try_element_at(a["done"], F.lit(-1)), F.lit(" "), piece)))
        return F.when(F.size(a["now"]) == 0, a["done"]).when(fold, folded).otherwise(F.concat(a["done"], F.array(piece)))

    return F.aggregate(counted, zero, step, end)


def chunks(records: DataFrame, key: str, title: str, body: str) -> DataFrame:
    """key, chunk_index, chunk_id, heading, heading_path, content, word_count, pii: pieces of MIN words at least,
    numbered after that filter. A record's chunks are made and numbered in its own row: nothing is shuffled."""
    piece = lambda s, p: F.struct(s["path"].alias("path"), T.strip(p).alias("content"), T.word_count(p).alias("n"))
    split = lambda c: F.when(T.word_count(c) <= MAX, F.array(c)).otherwise(split_long(c))
    pieces = F.flatten(F.transform(section_array(F.col(body)), lambda s: F.transform(split(s["content"]), lambda p: piece(s, p))))
    c = records.select(key, title, F.posexplode(F.filter(pieces, lambda p: p["n"] >= MIN)).alias("chunk_index", "p")).select(key, title, "chunk_index", "p.*")
    heading = F.coalesce(F.try_element_at("path", F.lit(-1)), F.col(title))
    ident = F.format_string("%s_c%02d", F.col(key).cast("string"), "chunk_index")
    return c.select(key, "chunk_index", ident.alias("chunk_id"), heading.alias("heading"), F.col("path").alias("heading_path"), "content", F.col("n").alias("word_count"), T.has_redaction(F.col("content")).alias("pii"))


def embedding_text(title: Column, path: Column, content: Column) -> Column:
    """`title. heading > heading. content`, without the path where there is none."""
    prefix = F.array_join(F.coalesce(path, F.array().cast("array<string>")), " > ")
    return F.concat(F.coalesce(title, F.lit("")), F.when(prefix != "", F.concat(F.lit(". "), prefix)).otherwise(""), F.lit(". "), F.coalesce(content, F.lit("")))
