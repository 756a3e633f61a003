"""Main content of HTML pages: structured walk, payload JSON, plain stripping, and the best of them."""

from __future__ import annotations

import html as H
import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions import text as T

#: Class or id marks of page chrome, subtrees that are never content, and elements that are. Fixed values.
CHROME = r"cookie|privacy-statement|disclaimer-modal|modal|nav|footer|header|breadcrumb|skip-link|social|share-"
DROPPED = ("script", "style", "noscript", "svg", "iframe", "form", "button")
CONTENT = ("h1", "h2", "h3", "h4", "p", "li", "td", "th", "dt", "dd")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Walker(HTMLParser):
    """Collects content elements in document order, each with its own and nested text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, list[str] | None]] = []
        self.found: list[tuple[str, list[str], bool]] = []
        self.has_main = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _VOID:
            return
        named = dict(attrs)
        skip = bool(self.open and self.open[-1][1]) or tag in DROPPED or (tag not in ("html", "body", "main") and any(re.search(CHROME, named.get(k) or "", re.I) for k in ("class", "id")))
        main = tag == "main" or named.get("id") == "main-content"
        self.has_main |= main
        inside = main or any(t == "main*" for t, _, _ in self.open)
        text: list[str] | None = None
        if tag in CONTENT and not skip:
            text = []
            self.found.append((tag, text, inside))
        self.open.append(("main*" if main else tag, skip, text))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag or (tag in ("main", "div") and self.open[i][0] == "main*"):
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if (not self.open or not self.open[-1][1]) and data.strip():
            for _, _, text in self.open:
                if text is not None:
                    text.append(data.strip())


def structured(page: str) -> str:
    w = _Walker()
    w.feed(page or "")
    w.close()
    out, seen = [], set()
    for tag, parts, inside in w.found:
        line = " ".join(parts)
        if len(line) < 3 or (w.has_main and not inside) or line.lower() in seen:
            continue
        seen.add(line.lower())
        out.append(f"\n{'#' * int(tag[1])} {line}" if tag[0] == "h" else f"- {line}" if tag == "li" else line)
    return "\n".join(out).strip()


#: Keys of a page's state that hold its entries, and of an entry's title and body, the first that is set. Fixed values.
PAYLOAD_CONTENT_KEYS = ("faqs", "articles", "items", "posts", "contents")
PAYLOAD_TITLE_KEYS = ("title", "question", "name", "heading")
PAYLOAD_BODY_KEYS = ("description", "answer", "content", "body", "text")
#: A script that is one JSON object of some length. Fixed value.
PAYLOAD_SCRIPT = r"<script[^>]*>\s*(\{.{200,}?\})\s*</script>"


def flatten(fragment: str) -> str:
    """HTML inside a JSON field as text: breaks and ends of paragraphs and items are line feeds, other tags blanks."""
    text = H.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"(?i)<br\s*/?>|</p>|</li>", "\n", fragment)))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


def entries(state: object) -> Iterator[dict]:
    """The objects in lists under content keys, in document order; such lists are not searched any deeper."""
    todo = [state]
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):  # a list that is content
            yield from (x for x in node if isinstance(x, dict))
        elif isinstance(node, dict):
            todo += [tuple(v) if k in PAYLOAD_CONTENT_KEYS and isinstance(v, list) else v for k, v in reversed(node.items())]
        elif isinstance(node, list):
            todo += reversed(node)


def payload(page: str) -> str:
    """Titles (as headings) and bodies of the entries inside a page's JSON state; an entry whose title and body begin
    like an earlier one's (120 characters, whatever their case) is left out."""
    found: dict[str, list[str]] = {}
    for script in re.finditer(PAYLOAD_SCRIPT, page or "", re.S):
        try:
            state = json.loads(script[1])
        except ValueError:
            continue
        for e in entries(state):
            title, body = ("".join([str(e[k]) for k in keys if e.get(k)][:1]) for keys in (PAYLOAD_TITLE_KEYS, PAYLOAD_BODY_KEYS))
            if body := flatten(body):
                found.setdefault((title + body)[:120].lower(), [f"## {flatten(title)}"] * bool(title) + [body])
    return "\n".join(line for lines in found.values() for line in lines).strip()


def _each(f: Callable[[str], str], html: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: f(x or ""))

    return run(html)


def structured_text(html: Column) -> Column:
    return _each(structured, html)


def payload_text(html: Column) -> Column:
    return _each(payload, html)


def strip_html(page: Column) -> Column:
    """Scripts, styles and tags out, breaks and block ends as lines, common entities decoded, blanks squeezed."""
    t = F.regexp_replace(page, r"(?is)<(script|style|noscript|svg|iframe|form|button)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<br\s*/?>|</(p|li|h[1-4]|td|th|div)>", "\n"), r"<[^>]+>", " ")
    for entity, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(c))
    return T.strip(F.regexp_replace(F.regexp_replace(t, "[ \\t]+", " "), r"\n\s*\n+", "\n"))


def best_of(bodies: list[tuple[str, Column]]) -> Column:
    """struct<words, extractor, body> of the extractor with most words, the earlier on a tie."""
    each = [F.struct(T.word_count(F.coalesce(b, F.lit(""))).alias("words"), F.lit(-i).alias("o"), F.lit(name).alias("extractor"), F.coalesce(b, F.lit("")).alias("body")) for i, (name, b) in enumerate(bodies)]
    return F.array_max(F.array(*each))


def extract_pages(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, extractor, words, body."""
    both = pages.select(key, structured_text(F.col(html)).alias("a"), payload_text(F.col(html)).alias("b"), strip_html(F.col(html)).alias("c"))
    return both.select(key, best_of([("structured", F.col("a")), ("payload", F.col("b")), ("plain", F.col("c"))]).alias("x")).select(key, "x.extractor", "x.words", "x.body")
