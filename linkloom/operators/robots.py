"""robots.txt rules as a join: one row of rules per host.

Precedence is that of RFC 9309: the longest matching rule decides, Allow wins a
tie, ``*`` matches anything and ``$`` the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.text import strip
from linkloom.functions.urls import url_host

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
SITEMAP = "(?i)^sitemap:"


def robots_lines(body: Column) -> Column:
    return F.split(body, LINE_BREAK)


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(host, pos, url) of every ``Sitemap:`` line."""
    lines = robots.select("host", F.posexplode(robots_lines(F.col("body"))).alias("pos", "_line"))
    trimmed = lines.withColumn("_line", strip(F.col("_line"))).filter(F.col("_line").rlike(SITEMAP))
    url = strip(F.regexp_replace("_line", SITEMAP, ""))
    return trimmed.select("host", "pos", url.alias("url")).filter("url <> ''")


#: Plain rules of a host beyond which they are sorted and searched instead of tried one by one.
INDEXED = 64
#: Parts groups of lines; no rule can hold it.
GROUP = "\u0001"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rule_lines(body: Column) -> Column:
    """The allow and disallow lines that count for every agent.

    Each step is one pass over the lines; no expression repeats a group, so neither the number
    of lines nor that of agents matters.
    """
    no_comments = F.translate(F.regexp_replace(body, r"#[^\r\n]*", ""), GROUP, "")
    known = F.regexp_extract_all(
        no_comments, F.lit(r"(?im)^[ \t]*((?:user-agent|allow|disallow)[ \t]*:[^\r\n]*)"), F.lit(1)
    )

    def agent(line: Column) -> Column:
        return line.rlike("(?i)^user-agent")

    def marked(lines: Column) -> Column:
        # A group begins with an agent that no agent stands before. The last pair has no line.
        return F.zip_with(
            lines,
            F.concat(F.array(F.lit("")), lines),
            lambda line, before: F.when(agent(line) & ~agent(before), F.concat(F.lit(GROUP), line)).otherwise(line),
        )

    groups = F.split(F.array_join(_let(known, marked), "\n"), GROUP)
    for_all = F.filter(groups, lambda g: g.rlike(r"(?im)^user-agent[ \t]*:[ \t]*\*[ \t]*$"))
    return F.flatten(
        F.transform(
            for_all,
            lambda g: F.regexp_extract_all(g, F.lit(r"(?im)^((?:allow|disallow)[ \t]*:[ \t]*[^ \t\n]+)"), F.lit(1)),
        )
    )


def _rule(line: Column) -> Column:
    """A line as allow, path, the parts between its stars, and whether ``$`` ends it."""
    path = F.regexp_extract(line, r":[ \t]*([^ \t]+)$", 1)
    parts = F.split(F.regexp_replace(path, r"\$$", ""), r"\*")
    return F.struct(
        line.rlike("(?i)^allow").alias("allow"), path.alias("path"), parts.alias("parts"), path.endswith("$").alias("ended")
    )


def _plain(rule: Column) -> Column:
    return (F.size(rule["parts"]) == 1) & ~rule["ended"]


def robots_rules(robots: DataFrame) -> DataFrame:
    """(host, rules) with the rules that apply to every agent.

    ``rules`` has the ones to be tried one by one (``listed``); a host with more than ``INDEXED`` rules
    that are mere prefixes has those in order (``sorted``), with their distinct ``lengths``.
    """

    def laid(every: Column) -> Column:
        def parted(plain: Column) -> Column:
            many = F.size(plain) > INDEXED
            pairs = F.transform(plain, lambda r: F.struct(r["path"].alias("path"), r["allow"].alias("allow")))
            return F.struct(
                F.when(many, F.filter(every, lambda r: ~_plain(r))).otherwise(every).alias("listed"),
                F.when(many, F.sort_array(pairs)).alias("sorted"),
                F.when(many, F.array_distinct(F.transform(plain, lambda r: F.length(r["path"])))).alias("lengths"),
            )

        return _let(F.filter(every, _plain), parted)

    return robots.select("host", _let(F.transform(_rule_lines(F.col("body")), _rule), laid).alias("rules"))


def _last_up_to(rules: Column, path: Column) -> Column:
    """Of sorted rules the last one whose path is not after ``path``, by halving."""
    size = F.size(rules)

    def halve(span: Column, _: Column) -> Column:
        middle = F.floor((span["low"] + span["high"]) / 2).cast("int")
        after = F.get(rules, middle)["path"] > path
        low = F.when(after, span["low"]).otherwise(middle + 1)
        return F.when(span["low"] >= span["high"], span).otherwise(
            F.struct(low.alias("low"), F.when(after, middle).otherwise(span["high"]).alias("high"))
        )

    steps = F.sequence(F.lit(1), F.ceil(F.log2(size + 1)).cast("int"))
    span = F.aggregate(steps, F.struct(F.lit(0).alias("low"), size.alias("high")), halve)
    return F.get(rules, span["low"] - 1)


def _matches(path: Column, rule: Column) -> Column:
    """Does the path begin with the parts, in order, with anything in between?

    Each part is taken where it stands first, which loses no match; the last one of a rule that
    is ended must end the path. Time grows with the path and the rule, whatever they hold.
    """
    first, last = rule["parts"][0], F.element_at(rule["parts"], -1)
    many = F.size(rule["parts"]) > 1
    inner = F.when(
        rule["ended"], F.slice(rule["parts"], 2, F.greatest(F.size(rule["parts"]) - 2, F.lit(0)))
    ).otherwise(F.slice(rule["parts"], 2, F.size(rule["parts"])))

    def after(at: Column, part: Column) -> Column:
        found = F.call_function("locate", part, path, at + 1)
        return F.when((at < 0) | (part == ""), at).when(found == 0, F.lit(-1)).otherwise(found - 1 + F.length(part))

    at = F.aggregate(inner, F.length(first), after)
    ended = F.when(many, path.endswith(last) & (F.length(path) - F.length(last) >= at)).otherwise(path == first)
    return F.when(~path.startswith(first), F.lit(False)).otherwise((at >= 0) & (~rule["ended"] | ended))


def allowed(url: str, rules: Column) -> Column:
    """May any agent fetch ``url`` under these rules? No rules allow everything."""
    target = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^#]*)", 1)
    path = F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target))

    def applies(rule: Column) -> Column:
        return F.when(_plain(rule), path.startswith(rule["path"])).otherwise(_matches(path, rule))

    def hit(length: Column, allow: Column) -> Column:
        return F.struct(length.alias("length"), allow.alias("allow"))

    listed = F.transform(F.filter(rules["listed"], applies), lambda r: hit(F.length(r["path"]), r["allow"]))

    def searched(length: Column) -> Column:
        # Of equal paths the last one is an Allow, if there is one.
        prefix = F.left(path, length)
        return _let(_last_up_to(rules["sorted"], prefix), lambda e: F.when(e["path"] == prefix, hit(length, e["allow"])))

    fitting = F.filter(rules["lengths"], lambda n: n <= F.length(path))
    looked_up = F.when(rules["sorted"].isNotNull(), F.array_max(F.transform(fitting, searched)))
    return F.coalesce(F.greatest(F.array_max(listed), looked_up)["allow"], F.lit(True))


def robots_filter(urls: DataFrame, robots: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose URL any agent may fetch; hosts without rules allow everything.

    The rules of a host arrive as one value, so a URL meets its rules inside its
    own row and no (URL, rule) pairs are built.
    """
    rules = robots_rules(robots).select(F.lower("host").alias("_host"), F.col("rules").alias("_rules"))
    joined = urls.withColumn("_host", F.lower(url_host(url))).join(rules, "_host", "left")
    return joined.filter(allowed(url, F.col("_rules"))).drop("_host", "_rules")
