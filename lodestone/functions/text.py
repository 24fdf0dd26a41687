"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words that query cleaning removes.
STOP_WORDS = tuple(
    """
    the a an is are was were be been being have has had do does did will would could should may might must shall can
    need dare ought used to of in for on with at by from as into through during before after above below between under
    again further then once here there when where why how all each few more most other some such no nor not only own
    same so than too very just and but if or because until while what which who whom this that these those am it its
    our ours you your yours he him his she her hers they them their theirs we us i me my mine
    """.split()
)

# The phrasings that a question is expanded to.
TEMPLATES = (
    "{q}",
    "What is {q}?",
    "Explain {q}",
    "Details about {q}",
    "Represent this question for searching relevant passages: {q}",
    "Given a question, find the most relevant document: {q}",
)

BETWEEN_WORDS = r"[^\p{L}\p{N}_]+"


def is_stop_word(term: Column) -> Column:
    """A look-up in a hash set."""
    return term.isin(*STOP_WORDS)


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text; case and blanks matter."""
    return F.sha2(text.cast("binary"), 256)


def node_id(doc: Column, level: Column, start: Column, end: Column) -> Column:
    """First 16 hex digits of the SHA-1 over `doc|level:start:end`."""
    return F.substring(F.sha1(F.concat(doc.cast("string"), F.lit("|"), level.cast("string"), F.lit(":"), start.cast("string"), F.lit(":"), end.cast("string")).cast("binary")), 1, 16)


def truncated(text: Column, n: int = 2000) -> Column:
    return F.substring(text, 1, n)


def snippet(text: Column, n: int = 240, more: str = "…") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(more))).otherwise(text)


def preview(text: Column, n: int = 200) -> Column:
    return snippet(text, n, "...")


def collapsed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " ")


def collapsed_preview(text: Column, n: int = 500) -> Column:
    """Blanks collapsed, cut to n; dots if the raw text was longer."""
    cut = F.substring(collapsed(text), 1, n)
    return F.when(F.length(text) > n, F.concat(cut, F.lit("..."))).otherwise(cut)


def title(text: Column, fallback: Column, n: int = 100) -> Column:
    """First line, cut to n; the fallback where that is blank."""
    line = F.substring(F.split(text, "\n")[0], 1, n)
    return F.when(F.trim(line) == "", fallback).otherwise(F.coalesce(line, fallback))


def bare_id(path: Column) -> Column:
    """The `dsid_` id within a path, empty if there is none."""
    return F.regexp_extract(path, "dsid_[a-f0-9]{32}", 0)


def id_before_slug(path: Column) -> Column:
    return F.split_part(path, F.lit("__"), F.lit(1))


def iso_time(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss")


def blank_tokens(text: Column) -> Column:
    """Lower-cased parts between blanks."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def words(text: Column) -> Column:
    """Lower-cased words of two characters or more."""
    return F.filter(F.split(F.lower(text), BETWEEN_WORDS), lambda t: F.length(t) >= 2)


def query_terms(question: Column, most: int = 20, fallback: int = 10) -> Column:
    """Up to `most` meaningful terms; the first raw ones where nothing is meaningful."""
    raw = blank_tokens(question)
    kept = F.filter(raw, lambda t: (F.length(t) > 2) & ~is_stop_word(t))
    return F.when(F.size(kept) > 0, F.slice(kept, 1, most)).otherwise(F.slice(raw, 1, fallback))


def or_query(question: Column, most: int = 20) -> Column:
    return F.array_join(query_terms(question, most), " | ")


def variants(question: Column, passage: Column | None = None) -> Column:
    """The phrasings of a question and its hypothetical passage, in order, without repeats."""
    made = [F.concat(F.lit(t.split("{q}")[0]), question, F.lit(t.split("{q}")[1])) for t in TEMPLATES]
    if passage is not None:
        made.append(passage)
    return F.filter(F.array_distinct(F.array(*made)), lambda v: v.isNotNull() & (v != ""))


def token_estimate(characters: Column) -> Column:
    """Four characters a token, one token at least."""
    return F.greatest(F.lit(1), F.floor(characters / 4)).cast("long")


def clamp(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
