"""Column functions on text: tokens, normalisation, personal data, dates, citations."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Canonical terms by variant; the case of a match's first letter is kept. Fixed values.
TERMINOLOGY = {
    "variable unit linked": "variable unit-linked",
    "unit linked": "unit-linked",
    "pre need": "pre-need",
    "banc assurance": "bancassurance",
    "policy holder": "policyholder",
    "policy holders": "policyholders",
    "face amount": "sum assured",
}
#: Personal data by label. Fixed values.
PII = {
    "email": r"\b[\w.+-]+@[\w-]+\.[\w.]{2,}\b",
    "ph_mobile": r"(?:\+63|0)9\d{2}[\s-]?\d{3}[\s-]?\d{4}\b",
    "ph_landline": r"\(0?2\)\s?\d{4}[\s-]?\d{4}\b|\b\(0?\d{2,3}\)\s?\d{3}[\s-]?\d{4}\b",
    "tin": r"(?i)\bTIN[:\s#]*\d{3}-?\d{3}-?\d{3}(?:-?\d{3,5})?\b",
    "policy_number": r"(?i)\b(?:policy|contract)\s*(?:no\.?|number|#)[:\s]*([A-Z0-9-]{6,})\b",
    "sss_gsis": r"(?i)\b(?:SSS|GSIS)[:\s#]*\d{2}-?\d{7}-?\d\b",
}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: A citation of a chunk or of an authored answer. Fixed value.
CITATION = r"\[((?:faq_[a-z0-9_]+)|(?:[a-z0-9_]+_c\d+))\]"


def tokens(t: Column) -> Column:
    """Lower-case ASCII words and numbers."""
    return F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0))


def word_tokens(t: Column) -> Column:
    """Lower-case runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def word_count(t: Column) -> Column:
    return F.size(F.regexp_extract_all(t, F.lit(r"[^\s]+"), F.lit(0)))


def strip(t: Column) -> Column:
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def nfkc(t: Column) -> Column:
    """Unicode compatibility normalisation, which has no built-in."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return run(t)


def normalise(t: Column, terms: Mapping[str, str] = TERMINOLOGY) -> Column:
    """Blanks, currency amounts and terms in one form. Apply nfkc first where the text may need it."""
    t = F.translate(t, " ​", " ")
    t = F.regexp_replace(F.regexp_replace(t, "[ \\t]+", " "), "\\n{3,}", "\n\n")
    for pattern in (r"[Pp]hp\s?([\d,]+)", r"₱\s?([\d,]+)", r"\bP\s?([\d,]{4,})"):
        t = F.regexp_replace(t, pattern, "PHP $1")
    for variant, canon in terms.items():
        first, rest = variant[0], variant[1:]
        t = F.regexp_replace(t, rf"\b{first.upper()}(?i:{rest})\b", canon[0].upper() + canon[1:])
        t = F.regexp_replace(t, rf"\b{first.lower()}(?i:{rest})\b", canon)
    return strip(t)


def iso_dates(t: Column) -> tuple[Column, Column]:
    """(text with dates as YYYY-MM-DD, how many changed). Day month year, then month day year, then slashes, which are
    read as month first; each pass sees the one before. Numbers are rewritten, not validated."""
    changed = F.lit(0)
    pad = lambda x: F.regexp_replace(x, r"\x02(\d)\x03", "0$1")
    clean = lambda x: F.regexp_replace(pad(x), "[\\x02\\x03]", "")
    any_month = "|".join(MONTHS)
    for order in ("dmy", "mdy"):
        whole = rf"(?i)\b\d{{1,2}}\s+(?:{any_month})\s+\d{{4}}\b" if order == "dmy" else rf"(?i)\b(?:{any_month})\s+\d{{1,2}},?\s+\d{{4}}\b"
        changed = changed + F.regexp_count(t, F.lit(whole))
        for i, m in enumerate(MONTHS, 1):
            pattern, to = (rf"(?i)\b(\d{{1,2}})\s+{m}\s+(\d{{4}})\b", f"$2-{i:02d}-\x02$1\x03") if order == "dmy" else (rf"(?i)\b{m}\s+(\d{{1,2}}),?\s+(\d{{4}})\b", f"$2-{i:02d}-\x02$1\x03")
            t = F.regexp_replace(t, pattern, to)
        t = clean(t)
    slash = r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
    changed = changed + F.regexp_count(t, F.lit(slash))
    return clean(F.regexp_replace(t, slash, "$3-\x02$1\x03-\x02$2\x03")), changed


def heading(t: Column, suffix: str | None = None) -> Column:
    """Without the site's suffix (a pattern, cut off with what follows it), blanks squeezed; what is long and all in
    capitals gets a capital for the first letter of each run of letters only."""
    t = strip(t) if suffix is None else strip(F.regexp_replace(t, rf"(?is)\s*{suffix}.*$", ""))
    t = F.regexp_replace(t, r"\s+", " ")
    runs = F.regexp_extract_all(t, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.when((F.upper(t) == t) & (F.lower(t) != t) & (F.length(t) > 8), F.array_join(F.transform(runs, F.initcap), "")).otherwise(t)


def pii_found(t: Column, patterns: Mapping[str, str] = PII) -> Column:
    """array<struct<label, matches>> of the labels that match, matches sorted and distinct."""
    each = [F.struct(F.lit(k).alias("label"), F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(p), F.lit(0)))).alias("matches")) for k, p in patterns.items()]
    return F.filter(F.array(*each), lambda x: F.size(x["matches"]) > 0)


def redact(t: Column, patterns: Mapping[str, str] = PII) -> Column:
    for k, p in patterns.items():
        t = F.regexp_replace(t, p, f"[{k.upper()}_REDACTED]")
    return t


def has_redaction(t: Column) -> Column:
    return t.rlike(r"\[[A-Z_]+_REDACTED\]")


def strip_fillers(query: Column, fillers: Sequence[str]) -> Column:
    """Without whole-token fillers; the query as it was if fewer than two words would stay."""
    if not fillers:
        return query
    import re

    out = F.regexp_replace(query, r"(?i)\b(?:" + "|".join(map(re.escape, fillers)) + r")\b", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"^[ ,.?!]+|[ ,.?!]+$", "")
    return F.when(word_count(out) >= 2, out).otherwise(query)


def citations(t: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(CITATION), F.lit(1))))


def strip_citations(t: Column) -> Column:
    return strip(F.regexp_replace(t, r"\s*" + CITATION, ""))


def retry_after(t: Column) -> Column:
    """Seconds of the first `12.5ms`, `2m` or `3s`; null if none."""
    n = F.try_to_number(F.regexp_extract(t, r"([\d.]+)(ms|m|s)", 1), F.lit("999999.999")).cast("double")
    unit = F.regexp_extract(t, r"([\d.]+)(ms|m|s)", 2)
    return F.when(unit == "ms", n / 1000).when(unit == "m", n * 60).when(unit == "s", n)


def shingles(t: Column, k: int = 4) -> Column:
    """k-token shingles; the tokens themselves if fewer. The tokens are bound to a name, or each shingle would split the
    whole text again."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " "))
    return F.transform(F.array(word_tokens(t)), lambda w: F.when(F.size(w) < k, w).otherwise(runs(w)))[0]
