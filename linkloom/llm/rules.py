"""Quality classifier: a sparse rule ensemble.

Shallow trees are grown on text statistics; the path to every node but the root is a
rule, a conjunction of comparisons. A lasso-penalised logistic regression weighs the
rules and drops most. What is left is compiled into one Column expression, so scoring
runs as plain projections over whole texts.

Only the fit uses a sample: at most about ``SAMPLE`` labelled rows, drawn by hash. The
sample's ids are the only rows that are broadcast.

Defined cases: a null text counts as empty and is scored as such; texts of any length are
scored whole; null labels are left out; without labelled rows of both classes the score is the share of
ones, 0.5 where there are none; repeated rows are scored one by one. A drawn label teaches each
row of its id, so an id that many documents share makes the sample larger by those.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import UPPER, remainder, table
from linkloom.session import cut_lineage

SAMPLE = 20_000
TREES = 12
DEPTH = 4
PENALTY = 0.002

Rule = tuple[tuple[str, bool, float], ...]  # (statistic, above, bound)


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` without ``text``, with the statistics of the whole text."""
    others = [c for c in docs.columns if c != "text"]
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        *others,
        text.alias("t"),
        F.split(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")), " ").alias("w"),
        F.split(text, "\n").alias("l"),
    )
    n_chars = F.length("t")
    n_words = F.size("w")

    def without(chars: str) -> Column:
        return F.length(F.translate("t", chars, ""))

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    return base.select(
        *others,
        F.log1p(n_words.cast("double")).alias("s_words"),
        share(n_chars, n_words).alias("s_word_chars"),
        share(F.size(F.array_distinct("w")), n_words).alias("s_distinct_words"),
        share(F.size(F.array_distinct("l")), F.size("l")).alias("s_distinct_lines"),
        share(n_words, F.size("l")).alias("s_line_words"),
        share(n_chars - without(UPPER), n_chars).alias("s_upper"),
        share(n_chars - without("0123456789"), n_chars).alias("s_digits"),
        share(n_chars - without(".,;:?!'\"()-"), n_chars).alias("s_marks"),
        share(n_chars - without("#$%&*+/<=>@[\\]^_`{|}~"), n_chars).alias("s_symbols"),
        share(n_chars - without("!"), n_chars).alias("s_cries"),
    )


STATISTICS = [
    "s_words", "s_word_chars", "s_distinct_words", "s_distinct_lines", "s_line_words",
    "s_upper", "s_digits", "s_marks", "s_symbols", "s_cries",
]


def paths(node, names: list[str], path: Rule = ()) -> list[Rule]:
    """Rules of all nodes below ``node`` of a fitted tree."""
    if node.subtreeDepth() == 0:
        return []
    name, bound = names[node.split().featureIndex()], node.split().threshold()
    out = []
    for above, child in ((False, node.leftChild()), (True, node.rightChild())):
        rule = simplest((*path, (name, above, bound)))
        out += [rule, *paths(child, names, rule)]
    return out


def simplest(path: Rule) -> Rule:
    """One bound a side and statistic: the tightest."""
    tight: dict[tuple[str, bool], float] = {}
    for name, above, bound in path:
        old = tight.get((name, above), bound)
        tight[name, above] = max(old, bound) if above else min(old, bound)
    return tuple(sorted((n, a, b) for (n, a), b in tight.items()))


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for name, above, bound in rule:
        out = out & (F.col(name) > bound if above else F.col(name) <= bound)
    return out


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Column:
    """Score expression from rows with the statistics and ``label`` (0 or 1)."""
    seen = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        return F.lit(float(next(iter(seen), 0.5)))
    vectors = VectorAssembler(inputCols=STATISTICS, outputCol="x").transform(rows).select("x", "label")
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=7
    ).fit(vectors)
    rules = sorted({rule for tree in forest.trees for rule in paths(tree._java_obj.rootNode(), STATISTICS)})
    if not rules:
        return F.lit(seen[1] / (seen[0] + seen[1]))
    hit = rows.select("label", *(holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)))
    hit = cut_lineage(VectorAssembler(inputCols=hit.columns[1:], outputCol="x").transform(hit).select("x", "label"), "rule-hits")
    lasso = LogisticRegression(
        featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=100
    ).fit(hit)
    odds = F.lit(float(lasso.intercept))
    for weight, rule in zip(lasso.coefficients.toArray(), rules):
        if weight:
            odds = odds + F.when(holds(rule), F.lit(float(weight))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> DataFrame:
    """Statistics and label of a bounded draw of the rows that may be learned from."""
    known = labels.where(F.col(label).isin(0, 1) & (remainder(F.col("doc_id"), 3) != 1)).select(
        "doc_id", F.col(label).cast("int").alias("label")
    )
    share = min(1.0, sample / max(known.count(), 1))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return cut_lineage(statistics(texts), "labelled-statistics").drop("doc_id")


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text) and (doc_id, label) -> doc_id, held_out, score, predicted."""
    score = fit(labelled(docs, labels, label, sample))
    rows = statistics(docs.select("doc_id", "text")).select(
        "doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), score.alias("score")
    )
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
