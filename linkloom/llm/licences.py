"""Licence scans: text against licence templates by Dice coefficient over word bigrams.

Every line of a text, and the whole text if it has several lines, is a unit. Units and
templates are lower-cased and cut into runs of letters and digits. With a and b bigrams
and c in common (repeats counted), Dice is 2c / (a + b); it can reach ``LEAST`` only if
a / b lies between LEAST / (2 - LEAST) and its inverse, so other templates are pruned
by size before any bigram is looked at. Of each unit the best template is kept.

A notice inside a longer line, or wrapped in other text, is a span: a run of words that
begins and ends in a template's bigrams, across line ends, of a length that can reach
``LEAST``. Of spans and matching units that overlap, the one with most common bigrams
times Dice is kept; units are always reported. The unit of a span is the line it begins
in, so a line can be reported several times.

Defined cases: a null or empty text has no unit that matches; ties go to the first
template by name; repeated rows are reported one by one; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import table
from linkloom.session import cut_lineage

LEAST = 0.8
#: Templates are broadcast up to this many bytes of text; beyond, joined by shuffle.
BROADCAST_BYTES = 1 << 20
#: Bigrams of a short template.
SHORT = 8
#: Texts are looked through for up to this many bigrams that a match needs.
NEEDED = 256

# Public licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
    "except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-2-Clause": "Released under the BSD 2-Clause License",
    "BSD-3-Clause": "Released under the BSD 3-Clause License",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-4.0 work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring "
    "rights to this work",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MIT notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the Software), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Reserved": "All rights reserved",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}


def normal(text: Column) -> Column:
    """Lower case; runs of other characters than letters, digits and line ends are a blank."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")


def words(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"[ \n]+", " ")), " ")


def bigrams(own: str) -> Column:
    n = F.size(own) - 1
    return F.zip_with(F.slice(own, 1, n), F.slice(own, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def units(docs: DataFrame, text: str) -> DataFrame:
    """One row per unit: columns of ``docs`` but the text, ``unit`` (line from 0, or -1
    for the whole text), ``words``."""
    lines = docs.withColumn("norm", normal(F.col(text))).drop(text).withColumn("lines", F.split("norm", "\n"))
    whole = F.when(F.size("lines") > 1, F.array("norm")).otherwise(F.array().cast("array<string>"))
    each = lines.withColumn("all", F.concat("lines", whole)).withColumn("n_lines", F.size("lines")).drop("norm", "lines")
    kept = [c for c in docs.columns if c != text]
    out = each.select(*kept, "n_lines", F.posexplode("all").alias("pos", "line"))
    unit = F.when(F.col("pos") < F.col("n_lines"), F.col("pos")).otherwise(-1)
    return out.select(*kept, unit.alias("unit"), words(F.col("line")).alias("words"))


def needed(templates: dict[str, str], least: float) -> list[str]:
    """Bigrams of which any text that matches a template has one.

    A match at ``least`` has at least b * least / (2 - least) of a template's b bigrams,
    so it cannot be without all of some that make up more than the rest.
    """
    out: set[str] = set()
    for text in templates.values():
        own = normal_words(text)
        count = Counter(f"{x} {y}" for x, y in zip(own, own[1:]))
        b = sum(count.values())
        spare = b - math.ceil(b * least / (2 - least) - 1e-9)
        for bigram in sorted(count, key=lambda x: (x not in out, -len(x), x)):
            if spare < 0:
                break
            out.add(bigram)
            spare -= count[bigram]
    return sorted(out)


def laid_lines(own: DataFrame) -> DataFrame:
    """Lines that have words, of ``units``, with ``off``, the words of their text before
    them, and ``next``, the first word after them."""
    lines = own.where((F.col("unit") >= 0) & (F.element_at("words", 1) != ""))
    order = Window.partitionBy("mark").orderBy("unit")
    off = F.coalesce(F.sum(F.size("words")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("off", off).withColumn("next", F.lead(F.element_at("words", 1)).over(order))


def spans(lines: DataFrame, known: DataFrame, reach: int, most: int, least: float) -> DataFrame:
    """Of each template and place in a text where one of its bigrams stands, the best
    run of words from there that reaches ``least``, across line ends: mark, doc_id,
    unit (line it begins in), licence, dice, common, first and last word.

    No run is longer than ``reach`` bigrams, so work grows with the text, whatever it repeats.
    ``most`` is how often a template may have a bigram.
    """
    low, high = least / (2 - least), (2 - least) / least
    run = F.when(F.col("next").isNull(), F.col("words")).otherwise(F.concat("words", F.array("next")))
    each = lines.withColumn("run", run).select("mark", "doc_id", "unit", "off", F.posexplode(bigrams("run")).alias("i", "bigram"))
    hits = each.withColumn("s", F.col("off") + F.col("i")).join(known, "bigram")
    # A bigram counts in a run from s if it was there fewer times since s than the template has it.
    same = Window.partitionBy("mark", "licence", "bigram").orderBy("s")
    back = F.coalesce(*(F.when(F.col("in_b") == k, F.lag("s", k).over(same)) for k in range(1, most + 1)), F.lit(-1))
    hits = hits.withColumn("back", back)
    ahead = Window.partitionBy("mark", "licence").orderBy("s").rangeBetween(0, reach)
    hits = hits.withColumn("n", F.count(F.lit(1)).over(ahead))
    to_come = F.when(F.col("n") >= F.col("b") * low - 1e-9, F.collect_list(F.struct("s", "back")).over(ahead))
    hits = hits.withColumn("to_come", to_come).where(F.col("to_come").isNotNull())
    own = F.filter("to_come", lambda x: x["s"] - F.col("s") + 1 <= F.col("b") * high + 1e-9)

    def grow(best: Column, x: Column) -> Column:
        common = best["common"] + (x["back"] < F.col("s")).cast("int")
        a = x["s"] - F.col("s") + 1
        one = F.struct((2 * common / (a + F.col("b"))).alias("dice"), (-a).alias("minus"), common.alias("own"))
        return F.struct(common.alias("common"), F.greatest(best["best"], one).alias("best"))

    none = F.struct(F.lit(0.0).alias("dice"), F.lit(0).cast("long").alias("minus"), F.lit(0).alias("own"))
    found = F.aggregate(own, F.struct(F.lit(0).alias("common"), none.alias("best")), grow, lambda x: x["best"])
    best = hits.withColumn("best", found).where(F.col("best.dice") >= least - 1e-9)
    last = (F.col("s") - F.col("best.minus")).alias("e")
    return best.select("mark", "doc_id", "unit", "licence", F.col("best.dice").alias("dice"), F.col("best.own").alias("common"), "s", last)


#: Rounds in which spans that are better than all they overlap are taken before what is left is gathered.
ROUNDS = 2


def apart(found: DataFrame) -> DataFrame:
    """Spans that are left when, of those that overlap, the one with most common bigrams
    times Dice goes first; units are among ``found`` and win ties, but are not returned.

    A span that is the best one at each of its words is better than all it overlaps: it is taken, and
    what it overlaps goes. Words are groups of their own, so a text of any length is spread out. After
    ``ROUNDS`` of that, what overlaps still, chains of rising spans, is taken one by one.
    """
    rank = F.struct((-F.round(F.col("common") * F.col("dice"), 9)).alias("minus"), "is_span", "licence", "s", "e", "unit")
    rest = found.select("mark", "doc_id", "dice", rank.alias("rank"))
    at = F.explode(F.sequence("rank.s", "rank.e")).alias("at")
    taken = None
    for n in range(ROUNDS):
        best = F.min("rank").over(Window.partitionBy("mark", "at"))
        words_ = rest.select("*", at).withColumn("best", best)
        judged = words_.groupBy("mark", "doc_id", "dice", "rank").agg(F.bool_and(F.col("best") == F.col("rank")).alias("peak"))
        judged = cut_lineage(judged, f"licence-peaks-{n}")
        peaks = judged.where("peak").drop("peak")
        covered = F.max("peak").over(Window.partitionBy("mark", "at"))
        left = judged.select("*", at).withColumn("hit", covered).groupBy("mark", "doc_id", "dice", "rank").agg(F.max("hit").alias("hit"))
        rest = cut_lineage(left.where("NOT hit").drop("hit"), f"licence-rest-{n}")
        taken = peaks if taken is None else taken.unionByName(peaks)
    rest = rest.withColumn("s", F.col("rank.s")).withColumn("e", F.col("rank.e"))
    order = Window.partitionBy("mark").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.col("s") > F.max("e").over(order), F.lit(True)).cast("int")
    run = Window.partitionBy("mark").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)
    islands = rest.withColumn("begins", begins).withColumn("island", F.sum("begins").over(run))
    lists = islands.groupBy("mark", "doc_id", "island").agg(F.sort_array(F.collect_list(F.struct("rank", "dice"))).alias("list"))
    meets = lambda k, x: (k["rank"]["s"] <= x["rank"]["e"]) & (x["rank"]["s"] <= k["rank"]["e"])
    kept = F.aggregate(
        "list", F.slice("list", 1, 0), lambda got, x: F.when(F.exists(got, lambda k: meets(k, x)), got).otherwise(F.concat(got, F.array(x)))
    )
    each = lists.select("doc_id", F.explode(kept).alias("x")).where("x.rank.is_span = 1")
    last = each.select("doc_id", "x.rank.unit", "x.rank.licence", "x.dice")
    if taken is None:
        return last
    return taken.where("rank.is_span = 1").select("doc_id", "rank.unit", "rank.licence", "dice").unionByName(last)


def template_rows(templates: DataFrame) -> dict[str, str]:
    """Templates of a table (licence, text), each as one text; a licence may have several rows of a name of their own."""
    return {r.licence: r.text for r in templates.where("licence IS NOT NULL AND text IS NOT NULL").select("licence", "text").collect()}


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, text) -> doc_id, unit, licence, dice of each unit that a template matches,
    and of each span that one matches and no better match overlaps.

    ``templates`` by name, or a table (licence, text) of whole licence texts.
    """
    if isinstance(templates, DataFrame):
        templates = template_rows(templates)
    spark = docs.sparkSession
    rows = F.array(*(F.struct(F.lit(k).alias("licence"), F.lit(v).alias("t")) for k, v in templates.items()))
    known = spark.range(1, numPartitions=1).select(F.inline(rows)).select("licence", words(normal(F.col("t"))).alias("words"))
    known = known.select("licence", (F.size("words") - 1).alias("b"), F.explode(bigrams("words")).alias("bigram"))
    known = known.groupBy("licence", "b", "bigram").agg(F.count(F.lit(1)).alias("in_b"))
    if sum(len(t.encode()) for t in templates.values()) <= BROADCAST_BYTES:
        known = F.broadcast(known)
    low, high = least / (2 - least), (2 - least) / least
    sizes = [len(normal_words(t)) - 1 for t in templates.values()]
    texts = docs.select("doc_id", "text")
    some = needed(templates, least)
    if len(some) <= NEEDED:
        flat = F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
        has = lambda t: reduce(or_, (F.contains(t, F.lit(f" {x} ")) for x in some))
        # In a list, so that the text is normalised once.
        texts = texts.where(F.exists(F.array(flat), has))
    texts = cut_lineage(texts.withColumn("mark", F.monotonically_increasing_id()), "licence-texts")
    every = units(texts, "text")
    own = every.withColumn("a", F.size("words") - 1)
    # Bounds are fractions; a unit that is just at one is not lost to rounding.
    own = own.where((F.col("a") >= min(sizes) * low - 1e-9) & (F.col("a") <= max(sizes) * high + 1e-9))
    own = own.select("mark", "doc_id", "unit", "a", F.explode(bigrams("words")).alias("bigram"))
    fits = (F.col("a") >= F.col("b") * low - 1e-9) & (F.col("a") <= F.col("b") * high + 1e-9)
    common = own.join(known, "bigram").where(fits)
    common = common.groupBy("mark", "doc_id", "unit", "a", "b", "licence", "bigram", "in_b").agg(F.count(F.lit(1)).alias("in_a"))
    shared = F.sum(F.least("in_a", "in_b"))
    dice = 2 * shared / (F.col("a") + F.col("b"))
    each = common.groupBy("mark", "doc_id", "unit", "a", "b", "licence").agg(dice.alias("dice"), shared.alias("common"))
    best = F.min(F.struct((-F.col("dice")).alias("minus"), "licence", "common")).alias("best")
    each = each.where(F.col("dice") >= least - 1e-9).groupBy("mark", "doc_id", "unit").agg(best)
    matched = cut_lineage(
        each.select("mark", "doc_id", "unit", F.col("best.licence").alias("licence"), (-F.col("best.minus")).alias("dice"), F.col("best.common").alias("common")),
        "licence-units",
    )
    lines = laid_lines(every)
    place = lines.select("mark", "unit", F.col("off").alias("s"), (F.col("off") + F.size("words") - 1).alias("e"))
    # A text that matches as a whole is no longer than a template may be.
    longest = math.floor(max(sizes) * high + 1e-9)
    whole = matched.where("unit = -1").withColumn("s", F.lit(0).cast("long")).withColumn("e", F.lit(longest).cast("long"))
    taken = matched.join(place, ["mark", "unit"]).unionByName(whole).withColumn("is_span", F.lit(0))
    most = max(Counter(zip(w, w[1:])).most_common(1)[0][1] for w in map(normal_words, templates.values()) if len(w) > 1)
    # Short templates look but a few words ahead.
    short = [n for n in sizes if n <= SHORT]
    parts = [(max(short), F.col("b") <= SHORT)] if short else []
    parts += [(max(sizes), F.col("b") > SHORT)] if len(short) < len(sizes) else []
    found = reduce(
        DataFrame.unionByName, [spans(lines, known.where(own), math.floor(n * high + 1e-9), most, least) for n, own in parts]
    ).withColumn("is_span", F.lit(1))
    return matched.select("doc_id", "unit", "licence", "dice").unionByName(apart(found.unionByName(taken)))


def normal_words(text: str) -> list[str]:
    """Words of a template, by the rule of ``normal`` for its ASCII text."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def op9(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT * FROM (VALUES %s) v(licence, t)
), tw AS (SELECT licence, string_split(trim(regexp_replace(lower(t), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM t
), tb AS (
  SELECT licence, len(w) - 1 AS b, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS bigram FROM tw
), tc AS (SELECT licence, b, bigram, count(*) AS in_b FROM tb GROUP BY ALL
), d AS (
  SELECT row_number() OVER () AS mark, doc_id,
         string_split(regexp_replace(lower(text), '[^\p{L}\p{N}\n]+', ' ', 'g'), chr(10)) AS lines FROM documents
), u AS (
  SELECT mark, doc_id, unnest(range(0, len(lines))) AS unit, unnest(lines) AS line FROM d
  UNION ALL SELECT mark, doc_id, -1, array_to_string(lines, ' ') FROM d WHERE len(lines) > 1
), uw AS (SELECT mark, doc_id, unit, string_split(trim(regexp_replace(line, ' +', ' ', 'g')), ' ') AS w FROM u
), ub AS (
  SELECT mark, doc_id, unit, len(w) - 1 AS a, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS bigram FROM uw
), uc AS (SELECT mark, doc_id, unit, a, bigram, count(*) AS in_a FROM ub GROUP BY ALL
), m AS (
  SELECT mark, doc_id, unit, licence, 2 * sum(least(in_a, in_b))::DOUBLE / (a + b) AS dice
  FROM uc JOIN tc USING (bigram) GROUP BY mark, doc_id, unit, licence, a, b
), r AS (
  SELECT *, row_number() OVER (PARTITION BY mark, unit ORDER BY dice DESC, licence) AS k FROM m WHERE dice >= 0.8
)
SELECT doc_id, CAST(unit AS INTEGER) AS unit, licence, dice FROM r WHERE k = 1
""" % ", ".join(f"('{k}', '{v}')" for k, v in TEMPLATES.items())
