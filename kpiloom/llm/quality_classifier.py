"""Quality classifier: a sparse ensemble of rules taken from the paths of a small forest.

Trees are grown over statistics of the texts; every path to a node is a conjunction of comparisons. A
logistic regression with an L1 penalty weighs these rules, and those it keeps become one column expression.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import SEPARATORS, materialised, words

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEATURES = (
    "log_words", "word_length", "distinct_words", "symbols", "marks", "upper", "digits", "bars",
    "repeated_lines", "line_words", "spaces",
)


@dataclass(frozen=True)
class Rule:
    """All of (feature, at_most, threshold): value <= threshold if at_most, else value > threshold."""

    conditions: tuple[tuple[int, bool, float], ...]

    def column(self, features: Sequence[str]) -> Column:
        out = F.lit(True)
        for k, at_most, t in self.conditions:
            out = out & ((F.col(features[k]) <= t) if at_most else (F.col(features[k]) > t))
        return out.cast("double")


@dataclass(frozen=True)
class Model:
    base: float
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]

    def score(self, features: Sequence[str] = FEATURES) -> Column:
        """Probability of a good text, as one expression over the statistics."""
        margin = F.lit(self.base)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            margin = margin + rule.column(features) * weight
        return 1 / (1 + F.exp(-margin))


def with_statistics(docs: DataFrame, with_row: bool = False) -> DataFrame:
    """doc_id, or the struct ``row`` of all columns, and the statistics of each text, null text counting as
    empty; shares are of characters."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.struct("*").alias("row") if with_row else F.col("doc_id")
    rows = docs.select(key, text.alias("body"), words(F.col("text")).alias("ws"),
                       F.filter(F.split(text, "\n"), lambda x: x != "").alias("lines"))
    chars = F.greatest(F.length("body"), F.lit(1))
    n = F.greatest(F.size("ws"), F.lit(1))
    n_lines = F.greatest(F.size("lines"), F.lit(1))

    def share(chars_of: str) -> Column:
        return (F.length("body") - F.length(F.translate("body", chars_of, ""))) / chars

    values = {
        "log_words": F.ln(F.size("ws") + 1.0),
        "word_length": F.length(F.translate("body", SEPARATORS, "")) / n,
        "distinct_words": F.size(F.array_distinct("ws")) / n,
        "symbols": share("#*$%&<>@^~{}[]\\=+_"),
        "marks": share("!?"),
        "upper": share(_UPPER),
        "digits": share("0123456789"),
        "bars": share("|"),
        "repeated_lines": 1 - F.size(F.array_distinct("lines")) / n_lines,
        "line_words": F.ln(n / n_lines + 1.0),
        "spaces": share(" "),
    }
    return rows.select("row" if with_row else "doc_id", *[values[f].cast("double").alias(f) for f in FEATURES])


def tree_rules(text: str) -> list[Rule]:
    """Rules of all nodes below the roots, from a forest's printed form, in order and without repeats."""
    rules: dict[Rule, None] = {}
    path: list[tuple[int, bool, float]] = []
    for line in text.splitlines():
        if line.strip().startswith("Tree "):
            path = []
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line)
        if found:
            del path[max(0, len(found[1]) - 4):]
            path.append((int(found[2]), found[3] == "<=", float(found[4])))
            rules[Rule(tuple(path))] = None
    return list(rules)


def fit(
    statistics: DataFrame, labels: DataFrame, max_rows: int = 20_000, trees: int = 20, depth: int = 3,
    penalty: float = 0.002, seed: int = 7,
) -> Model:
    """Model from ``labels`` (doc_id, label 0 or 1; null labels are ignored).

    ``max_rows`` bounds the labelled rows used: beyond it, those with a hash of the id below a threshold
    that keeps about this many. With no labels every text scores one half, with one class its smoothed
    share.
    """
    known = labels.where(F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("double").alias("label"))
    n, good = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    base = float((good + 1) / (n + 2))
    constant = Model(_logit(base), (), ())
    if good in (0, n):
        return constant
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * max_rows / n))
    # Dealt and ordered by id, so that the forest draws the same rows in every run.
    rows = materialised(
        statistics.join(known, "doc_id").repartition(6, "doc_id").sortWithinPartitions("doc_id", *FEATURES)
        .select("label", *FEATURES), "quality-train").persist()
    try:
        if rows.select("label").distinct().count() < 2:
            return constant
        forest = RandomForestClassifier(
            featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, maxBins=64,
            featureSubsetStrategy="onethird", minInstancesPerNode=10)
        vectors = rows.select("label", array_to_vector(F.array(*FEATURES)).alias("x"))
        rules = tree_rules(forest.fit(vectors).toDebugString)
        if not rules:
            return constant
        indicators = rows.select(
            "label", array_to_vector(F.array(*[r.column(FEATURES) for r in rules])).alias("x")).persist()
        lasso = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=penalty, maxIter=60)
        fitted = lasso.fit(indicators)
        indicators.unpersist()
    finally:
        rows.unpersist()
    used = [(r, float(w)) for r, w in zip(rules, fitted.coefficients.toArray(), strict=True) if w]
    return Model(float(fitted.intercept), tuple(r for r, _ in used), tuple(w for _, w in used))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text is divisible by 5. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    ``labels`` has (doc_id, quality). Only the text's statistics enter the score. Texts are read once: their
    statistics are written out, and both training and scoring read those. Null and empty texts are scored
    by their statistics like others, repeated rows alike. An empty table gives no rows.
    """
    statistics = materialised(with_statistics(docs), "quality-stats")
    learn = labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    model = fit(statistics, learn, **options)
    score = model.score()
    return statistics.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The documents whose score reaches ``threshold``, with their columns, in the order they are read."""
    learn = labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    model = fit(materialised(with_statistics(docs), "quality-stats"), learn, **options)
    return with_statistics(docs, with_row=True).where(model.score() >= threshold).select("row.*")
