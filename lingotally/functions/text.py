"""Text scalars: words, sentences, escaping, names, hashes, ratios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Unicode White_Space, once as a character list for btrim and once as a regex class.
WS_CHARS = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS_CLASS = r"\s\x{85}\p{Z}"
SENTENCE_END = r"(?<=[.!?\x{06D4}\x{061F}\x{3002}])"
TOKEN_BREAK = rf"[{WS_CLASS}.,!?\x{{060C}}\x{{061F}}\x{{061B}}]+"


def strip(text: Column) -> Column:
    """Trim Unicode white space on both sides (``trim`` alone removes only U+0020)."""
    return F.btrim(text, F.lit(WS_CHARS))


def is_blank(text: Column) -> Column:
    """Null, empty or white space only; trimming the left side alone stops at the first character."""
    return F.coalesce(F.ltrim(text, F.lit(WS_CHARS)) == "", F.lit(True))


def word_count(text: Column) -> Column:
    """Non-empty white-space separated tokens; null text counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{WS_CLASS}]+")), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, rf"[{WS_CLASS}]+"), lambda w: w != "")


def split_sentences(text: Column) -> Column:
    """Sentences in order, cut after each terminator, trimmed, empty ones dropped."""
    pieces = F.transform(F.split(text, SENTENCE_END), strip)
    return F.filter(pieces, lambda s: s != "")


def dialect_tokens(text: Column) -> Column:
    return F.filter(F.split(text, TOKEN_BREAK), lambda t: t != "")


def unique_char_ratio(text: Column) -> Column:
    n = F.length(text)
    distinct = F.size(F.array_distinct(F.split(text, "")))
    return F.when(n > 0, distinct / n).otherwise(0.0)


def head_sample(text: Column, n: int = 512) -> Column:
    return F.substring(text, 1, n)


def preview(text: Column, n: int = 80) -> Column:
    return F.substring(text, 1, n)


def html_escape(text: Column) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def csv_field(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\r\n]'), quoted).otherwise(F.coalesce(text, F.lit("")))


def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)


def sanitize_id(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_-]", "_")


def status_label(status: Column) -> Column:
    filled = F.when(F.coalesce(status, F.lit("")) == "", F.lit("needs_review")).otherwise(status)
    return F.upper(F.replace(filled, F.lit("_"), F.lit(" ")))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def short_path(path: Column) -> Column:
    """Last two components behind an ellipsis; a path that has no more is kept."""
    parts = F.split(path, "/")
    return F.when(
        F.size(parts) > 2, F.concat(F.lit("…/"), F.substring_index(path, "/", -2))
    ).otherwise(path)


def percent_done(processed: Column, total: Column) -> Column:
    """Whole percent, halves up; an empty batch is at 0."""
    share = F.floor(100.0 * processed / F.nullif(total, F.lit(0)) + 0.5)
    return F.coalesce(share, F.lit(0)).cast("bigint")


def strip_label_prefix(label: Column, prefix: str = "__label__") -> Column:
    return F.regexp_replace(label, f"^{prefix}", "")


def throughput(n: Column, millis: Column) -> Column:
    return F.when(millis > 0, n * 1000.0 / millis).otherwise(0.0)


def pending_mask(flagged: Column, translation: Column, mark: str) -> Column:
    return F.when(flagged, F.concat(F.lit(mark), translation)).otherwise(translation)


def missing_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))
