"""Text expressions. Everything here runs inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the tagline separators in order of priority.
TAGLINE_SEPARATORS = [" - ", " | ", " — ", " · ", " : "]

# White space as Unicode defines it, plus the four information separators that
# Java's Unicode class leaves out.
BLANK = r"[\s\x1c-\x1f]"


def empty_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def strip(value: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.regexp_replace(value, rf"(?U)^{BLANK}+|{BLANK}+$", "")


def cut(value: Column, limit: int | None) -> Column:
    """The first ``limit`` characters; all of them without a limit."""
    return value if limit is None else F.left(value, F.lit(limit))


def normalize_text(value: Column, limit: int | None = None) -> Column:
    """One blank between words, lower case; cut only if a ``limit`` is given."""
    single = F.regexp_replace(value, rf"(?U){BLANK}+", " ")
    return cut(F.lower(F.trim(single)), limit)


def text_key(value: Column) -> Column:
    """Key under which two titles or descriptions count as the same."""
    return F.lower(strip(F.coalesce(value, F.lit(""))))


def title_case(value: Column) -> Column:
    """Capitalise every run of letters that have case, also after any other character."""
    cased = r"\p{Lu}\p{Ll}\p{Lt}"
    runs = F.regexp_extract_all(value, F.lit(rf"([{cased}]+|[^{cased}]+)"), F.lit(1))
    capital = F.transform(
        runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.right(r, F.length(r) - 1)))
    )
    return F.array_join(capital, "")


def strip_tagline(value: Column) -> Column:
    """Cut a site title at the first separator present, tried in priority order."""
    cut = value
    for sep in reversed(TAGLINE_SEPARATORS):
        cut = F.when(F.contains(value, F.lit(sep)), F.substring_index(value, sep, 1)).otherwise(cut)
    return strip(cut)


def escape_parens(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))


def md_link(title: Column, url: Column, description: Column) -> Column:
    """``- [title](url): description``; an empty description adds nothing."""
    tail = F.coalesce(F.concat(F.lit(": "), empty_to_null(description)), F.lit(""))
    return F.concat(F.lit("- ["), title, F.lit("]("), escape_parens(url), F.lit(")"), tail)


def sha256(value: Column) -> Column:
    return F.sha2(F.coalesce(value, F.lit("")), 256)
