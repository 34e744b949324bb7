"""Mixing sources to target weights.

Every row gets a hash-random key. Rows are range-sorted by (source, key), running
sums of their word counts are put together from the sorted pieces, and each source
is cut at its exact budget, after as many whole epochs as the budget holds.

Defined cases: a null text has no words and is never taken; a null source is a
source of its own, last in order; a null id is a key like any other; repeated rows
are taken one by one; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import WORD, running, table, word_count
from linkloom.session import cut_lineage

WEIGHTS = (3, 1, 2)
RATIO = 1.5
EPOCHS = 2


def targets(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    ratio: float = RATIO,
    epochs: int = EPOCHS,
) -> DataFrame:
    """(source, source_size) -> (source, source_size, source_start, target).

    Weights repeat along the sources in code-point order, null last. The sources
    share ``ratio`` times all words by weight; a target stops at ``epochs`` times
    its source, and what is over goes to the others by weight until none is above.
    In the order of cap per weight the capped sources come first, so one pass of
    running sums finds them all. ``source_start`` counts the words of the sources
    before.
    """
    ranked = running(
        sizes,
        [F.col("source").asc_nulls_last()],
        pos="rank",
        sums={"source_start": "source_size"},
        name="mix-sources",
    )
    cycle = F.array(*(F.lit(w) for w in weights))
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * epochs)
    filled = running(
        ranked,
        [(F.col("cap") / F.col("weight")).asc(), F.col("rank").asc()],
        pos="place",
        sums={"caps_before": "cap", "weight_before": "weight"},
        name="mix-levels",
    )
    whole = ranked.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    share, all_weight = float(ratio) * (whole.words or 0), whole.weight or 0
    level = (F.lit(share) - F.col("caps_before")) / (F.lit(all_weight) - F.col("weight_before"))
    filled = filled.withColumn("capped", F.col("cap") <= F.col("weight") * level)
    rest = filled.where("capped").agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight")).first()
    free = all_weight - (rest.weight or 0)
    open_level = (share - (rest.cap or 0)) / free if free else 0.0
    return filled.select(
        "source",
        "source_size",
        "source_start",
        F.when(F.col("capped"), F.col("cap").cast("double"))
        .otherwise(F.col("weight") * open_level)
        .alias("target"),
    )


def row_key(salt: str) -> Column:
    """The hash-random key of a row; rows of one id have one key."""
    return F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def cuts(rows: DataFrame, weights: tuple[int, ...], ratio: float, epochs: int) -> DataFrame:
    """(source, key, size) -> one row per source: its target, the whole epochs it
    gives, and the key where its last epoch ends. ``left`` of the ``at_cut`` words
    at that key are still taken.
    """
    sizes = cut_lineage(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sizes")
    budget = F.floor(F.col("target") + 0.5)
    goal = targets(sizes, weights, ratio, epochs).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    )
    goal = cut_lineage(goal.withColumn("rest", budget - F.col("whole") * F.col("source_size")), "mix-goal")
    placed = running(
        rows.groupBy("source", "key").agg(F.sum("size").alias("words")),
        [F.col("source").asc_nulls_last(), F.col("key").asc()],
        sums={"words_before": "words"},
        name="mix-order",
    )
    left = F.col("rest") - (F.col("words_before") - F.col("source_start"))
    ends = (
        placed.alias("p")
        .join(goal.alias("g"), F.expr("p.source <=> g.source"))
        .withColumn("left", left)
        .where((F.col("left") > 0) & (F.col("left") <= F.col("words")))
        .select(F.col("p.source").alias("source"), F.col("key").alias("cut_key"), "left", F.col("words").alias("at_cut"))
    )
    out = goal.alias("g").join(ends.alias("e"), F.expr("g.source <=> e.source"), "left")
    return cut_lineage(
        out.select("g.source", "source_size", "target", "whole", "cut_key", "left", "at_cut"), "mix-cuts"
    )


def taken() -> Column:
    """Words the mix takes of a row joined with the cut of its source."""
    last = (
        F.when(F.col("key") < F.col("cut_key"), F.col("size"))
        .when(F.col("key") == F.col("cut_key"), F.floor(F.col("size") * F.col("left") / F.col("at_cut")))
        .otherwise(F.lit(0))
    )
    return (F.col("whole") * F.col("size") + last).cast("long")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    ratio: float = RATIO,
    epochs: int = EPOCHS,
    salt: str = "mix",
) -> DataFrame:
    """Rows of ``docs`` (doc_id, source, text) -> doc_id, source, size, source_size,
    target, taken.

    ``taken`` counts the words that the mix takes from the row: its size once per
    whole epoch, and in the last epoch what lies before the cut. Rows of one id
    share the words left at a cut in proportion to their sizes.
    """
    rows = cut_lineage(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_key(salt).alias("key")),
        "mix-rows",
    )
    ends = cuts(rows, weights, ratio, epochs)
    joined = rows.alias("d").join(ends.alias("c"), F.expr("d.source <=> c.source"))
    return joined.select("doc_id", "d.source", "size", "source_size", "target", taken().alias("taken"))


def mixed_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    ratio: float = RATIO,
    epochs: int = EPOCHS,
    salt: str = "mix",
) -> DataFrame:
    """The mix as rows of ``docs``, one for each epoch that a row is taken in.

    The row that the cut of its source falls into comes with its words up to the
    cut, joined by blanks, so a source gives its exact budget; ``n_chars``, if
    present, follows. The columns are those of ``docs``; rows without words go.
    """
    row = docs.select(F.struct(*docs.columns).alias("row"), "source", "doc_id", word_count(F.col("text")).alias("size"))
    row = row.select("row", "source", "size", row_key(salt).alias("key"))
    slim = cut_lineage(row.select("source", "size", "key"), "mix-rows")
    ends = cuts(slim, weights, ratio, epochs)
    dealt = (
        row.alias("d")
        .join(ends.alias("c"), F.expr("d.source <=> c.source"))
        .select("row", "size", taken().alias("taken"))
        .where(F.col("taken") > 0)
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size")))))
        .withColumn("keep", F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size")))
    )
    part = F.col("keep") < F.col("size")
    words = F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0))
    text = F.when(part, F.array_join(F.slice(words, 1, F.col("keep").cast("int")), " ")).otherwise(F.col("row.text"))
    dealt = dealt.withColumn("cut_text", text)

    def column(name: str) -> Column:
        if name == "text":
            return F.col("cut_text").alias(name)
        if name == "n_chars":
            return F.when(part, F.length("cut_text").cast(docs.schema[name].dataType)).otherwise(F.col("row.n_chars")).alias(name)
        return F.col("row").getField(name).alias(name)

    return dealt.select(*(column(c) for c in docs.columns))


def op4(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")
