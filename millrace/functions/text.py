"""Text expressions. Null counts as empty."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Lines that begin like this are furniture; function words; the reader's error line.
# A phrase ends where a word does; a copyright sign counts only with a word right behind it.
JUNK_LINE = r"(?i)^\s*(?:(?:share this|advertisement|sign up|subscribe|read more|related stories|cookie|accept all|newsletter|follow us|all rights reserved)(?:[^\p{L}\p{N}_]|$)|©[\p{L}\p{N}_])"
FRENCH = "le la les des du pour dans une est sur aux par avec cette selon sont leur plus entre ainsi nous ont etre fait aussi donc".split()
ENGLISH = "the of and to in for is that with from this has was are by on at as it be which".split()
WORD = "[a-zà-ÿ']{2,}"
READER_ERROR = r"(?i)Target URL returned error (\d{3})"
HEADLINE_SUFFIX = r"\s+-\s+([^-]{2,40})$"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"

CHUNK, STEP, LEAST = 1200, 1000, 120


def text_of(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def collapsed(value: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text_of(value), r"\s+", " "))


def cut_at_space(value: Column, limit: int) -> Column:
    """At most limit characters, back to the last space where that cuts a text."""
    head = F.substring(value, 1, limit)
    return F.when(F.length(value) <= limit, value).otherwise(F.trim(F.regexp_replace(head, " [^ ]*$", "")))


def tidy(value: Column, limit: int | None = None) -> Column:
    """Prose on one line without blank and furniture lines."""
    lines = F.filter(F.transform(F.split(text_of(value), r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: (x != "") & ~x.rlike(JUNK_LINE))
    out = collapsed(F.array_join(lines, " "))
    return cut_at_space(out, limit) if limit else out


def tidy_text(value: Column, limit: int | None = None) -> Column:
    out = collapsed(value)
    return cut_at_space(out, limit) if limit else out


def tidy_structured(value: Column, limit: int | None = None) -> Column:
    """White space collapsed inside lines; line breaks kept, runs of blank lines as one."""
    lines = F.transform(F.split(text_of(value), r"\r\n|\r|\n"), collapsed)
    out = F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")
    return cut_at_space(out, limit) if limit else out


def clip(value: Column, limit: int) -> Column:
    """A hard prefix."""
    return F.substring(text_of(value), 1, limit)


def without_control(value: Column) -> Column:
    """Without the control characters that no XML parser accepts."""
    return F.regexp_replace(text_of(value), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{FFFE}\x{FFFF}]", "")


def title_key(value: Column) -> Column:
    """The first eight words of over two letters, lower case: one story, whoever carries it."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text_of(value)), "[^a-z0-9 ]", " "), " "), lambda w: F.length(w) > 2)
    return F.array_join(F.slice(words, 1, 8), " ")


def tokens(value: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text_of(value)), F.lit("([a-z0-9]+)"), F.lit(1))


def ranking_text(title: Column, text: Column, chars: int = 240) -> Column:
    """What ranking sees of a row: its title and the opening of its text (400 for the reranker)."""
    return F.concat(text_of(title), F.lit(" "), F.substring(text_of(text), 1, chars))


def passages(value: Column, title: Column | None = None, size: int = CHUNK, step: int = STEP, least: int = LEAST) -> Column:
    """Overlapping windows of the collapsed text, those over ``least`` long, each with the title in front."""


    def windows(body: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(body) - 1, F.lit(0)), F.lit(step))
        return F.filter(F.transform(starts, lambda i: F.substring(body, i + 1, F.lit(size))), lambda x: F.length(x) > least)

    # bound as a lambda's variable the collapsed text is computed once, not once for each window
    cut = F.flatten(F.transform(F.array(collapsed(value)), windows))
    if title is None:
        return cut
    head = F.when(F.trim(text_of(title)) == "", "").otherwise(F.concat(F.trim(title), F.lit(". ")))
    return F.transform(cut, lambda x: F.concat(head, x))


def function_words(value: Column, words: list[str]) -> tuple[Column, Column]:
    """(number of words, how many are among ``words``)."""
    found = F.regexp_extract_all(F.lower(text_of(value)), F.lit(f"({WORD})"), F.lit(1))
    return F.size(found), F.size(F.filter(found, lambda w: w.isin(*words)))


def looks_latin(value: Column) -> Column:
    """At least 15 words, over 4 % of them function words of English or French."""
    n, hits = function_words(value, FRENCH + ENGLISH)
    return (n >= 15) & (hits / n > 0.04)


def looks_french(value: Column) -> Column:
    n, hits = function_words(value, FRENCH)
    return (n >= 15) & (hits / n > 0.06)


def headline(value: Column) -> tuple[Column, Column]:
    """(title, publisher) of a headline that ends in `` - Publisher``."""
    return F.regexp_replace(text_of(value), HEADLINE_SUFFIX, ""), F.regexp_extract(text_of(value), HEADLINE_SUFFIX, 1)


def without_tags(value: Column, limit: int = 600) -> Column:
    return F.substring(F.trim(F.regexp_replace(text_of(value), "<[^>]+>", " ")), 1, limit)


def cell(value: Column, limit: int = 200) -> Column:
    """A table cell on one line, without the column mark."""
    return F.substring(F.trim(F.translate(text_of(value), "\n|", " /")), 1, limit)


def reader_error(value: Column) -> Column:
    """The status that an external reader reports for the page, or an empty string."""
    return F.regexp_extract(F.substring(text_of(value), 1, 2000), READER_ERROR, 1)


def captions(pieces: Column, limit: int = 20000) -> Column:
    """Caption pieces as prose; bracketed cues are sounds, not speech."""
    said = F.filter(F.transform(pieces, lambda x: F.trim(text_of(x))), lambda x: (x != "") & ~(x.startswith("[") & x.endswith("]")))
    return F.substring(collapsed(F.array_join(said, " ")), 1, limit)


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(text_of(html), TITLE, 1))
