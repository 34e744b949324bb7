"""Classification and scoring of pages, junk and challenge tests."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.text import BLANK
from linkloom.functions.urls import let, lower_path, slash_count

# Path patterns in order of precedence.
CATEGORY_PATTERNS = [
    (r"/docs?(/|$)", "Documentation"),
    (r"/documentation(/|$)", "Documentation"),
    (r"/api(-ref|reference|docs)?(/|$)", "API Reference"),
    (r"/guide", "Guides"),
    (r"/tutorial", "Guides"),
    (r"/getting[_-]?started", "Getting Started"),
    (r"/quick[_-]?start", "Getting Started"),
    (r"/install", "Getting Started"),
    (r"/setup", "Getting Started"),
    (r"/blog(/|$)", "Blog"),
    (r"/news(/|$)", "Blog"),
    (r"/example", "Examples"),
    (r"/demo", "Examples"),
    (r"/sample", "Examples"),
    (r"/faq", "FAQ"),
    (r"/changelog", "Changelog"),
    (r"/release", "Changelog"),
    (r"/about", "About"),
    (r"/team", "About"),
    (r"/contact", "About"),
    (r"/pricing", "About"),
]

# Base score of each category, and of an unknown one.
BASE_SCORES = {
    "Getting Started": 0.9,
    "Documentation": 0.85,
    "API Reference": 0.8,
    "Guides": 0.75,
    "Examples": 0.7,
    "Core Pages": 0.6,
    "FAQ": 0.5,
    "Changelog": 0.4,
    "About": 0.4,
    "Blog": 0.35,
    "Other": 0.25,
}
UNKNOWN_SCORE = 0.3

# Titles of pages that are never worth listing.
JUNK_TITLES = [
    r"^page\s*not\s*found$",
    r"^404\b",
    r"^not\s*found$",
    r"^error\b",
    r"^access\s*denied$",
    r"^reset\s*password",
    r"^log\s*in$",
    r"^sign\s*(in|up)$",
    r"^Talk:",
    r"^.+\s+talk:",
    r"^Template:",
    r"^Category:",
    r"^Module:",
    r"^Draft:",
    r"^Special:",
    r"^User:",
    r"^File:",
    r"^MediaWiki:",
    r"[/:]Archive\s*\d+",
    r"^\d{4}$",
    r"^(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}$",
]

# Marks of a bot challenge, and how far into the page they count.
CHALLENGE_MARKS = [
    r"Access Denied",
    r"Just a moment\.\.\.",
    r"Enable JavaScript and cookies to continue",
    r"challenge-platform",
    r"Checking your browser",
    r"(?s:Attention Required.*Cloudflare)",
    r"cf-browser-verification",
    r"Pardon Our Interruption",
    r"Please verify you are a human",
    r"blocked.*bot",
]


def _spellings(pattern: str) -> list[str]:
    """All texts a path pattern stands for, without the slashes around them."""
    found = [""]
    for literal, some, one in re.findall(r"([\w-]+?)(?=\w\?|[\[(]|$)|[\[(]([^\])]+)[\])]\?|(\w)\?", pattern):
        if literal:
            ways = [literal]
        else:
            ways = ["", *(some.split("|") if "|" in some else some or one)]
        found = [f + w for f in found for w in ways]
    return found


# A pattern begins with a slash; some want the path or its part to end after it.
_ENDED = "(/|$)"
_RULES = [
    (spelling, pattern.endswith(_ENDED), name)
    for pattern, name in CATEGORY_PATTERNS
    for spelling in _spellings(pattern.removeprefix("/").removesuffix(_ENDED))
]


def page_category(url: str, depth: str) -> Column:
    """Category by the first matching path pattern, else by depth. Arguments are SQL text.

    One pass over the path: what stands after each slash is tried in the order of the
    patterns, and of all that is found the earliest pattern decides.
    """
    tried = "|".join(spelling + ("(?=/|$)" if ended else "") for spelling, ended, _ in _RULES)
    known = ", ".join(f"'{spelling}'" for spelling, _, _ in _RULES)
    names = ", ".join(f"'{name}'" for _, _, name in _RULES)
    places = f"transform(regexp_extract_all(p, r'/(?=({tried}))', 1), w -> cast(array_position(array({known}), w) AS int))"
    by_depth = f"if({depth} <= 1, 'Core Pages', 'Other')"
    found = let("w", places, f"if(size(w) = 0, {by_depth}, element_at(array({names}), array_min(w)))")
    return lower_path(url, "p", found)


def page_relevance(url: str, depth: str, category: str, in_sitemap: str = "false") -> Column:
    """Score in [0, 1]; deep pages and long paths lose, listed pages gain. Arguments are SQL text."""
    bases = " ".join(f"WHEN '{name}' THEN {score}D" for name, score in BASE_SCORES.items())
    base = F.expr(f"CASE {category} {bases} ELSE {UNKNOWN_SCORE}D END - {depth} * 0.1D + if({in_sitemap}, 0.1D, 0D)")
    long_path = F.greatest((slash_count(url) - 3) * F.lit(0.05), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(base - long_path, 2)))


def _any(text: str, patterns: list[str], flags: str, first: str = "") -> str:
    """Does one of the patterns match? One pass; ``first`` holds the letters they may begin with."""
    ahead = f"(?=[{first}])" if first else ""
    return f"({text} rlike r'{flags}{ahead}(?:{'|'.join(patterns)})')"


def is_junk_title(title: str) -> Column:
    """True for an empty title and for error, login, wiki-namespace and date pages."""
    tests = _any("t", JUNK_TITLES, "(?iuUd)")
    trimmed = rf"regexp_replace(coalesce({title}, ''), r'(?U)^{BLANK}+|{BLANK}+$', '')"
    return F.expr(let("t", trimmed, f"(t = '' OR {tests})"))


def is_challenge(html: str, window: int | None = None) -> Column:
    """Does a mark of a challenge page stand in the page, or in its first ``window`` characters?"""
    looked_at = html if window is None else f"substring({html}, 1, {window})"
    return F.expr(let("h", looked_at, _any("h", CHALLENGE_MARKS, "(?iud)", "".join(sorted({re.sub(r"^\(\?s:", "", m)[0] for m in CHALLENGE_MARKS})))))
