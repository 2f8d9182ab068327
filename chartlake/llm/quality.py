"""A quality classifier as a sparse ensemble of rules.

Statistics of the whole text are Spark columns. A small random forest on a bounded labelled sample proposes
conjunctions, one per tree path; a logistic regression with a lasso penalty keeps few of them; the kept rules
and weights are compiled into one column expression, so scoring is a plain projection.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlake.llm.common import fold_of, staged

#: Bound of the labelled sample, in documents of each label.
SAMPLE = 10_000
TREES, DEPTH, LASSO, THRESHOLD = 16, 4, 0.001, 0.7
#: (statistic index, whether at most, threshold)
Condition = tuple[int, bool, float]


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text; all finite, also for an empty text."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    at_least_one = F.greatest(n, F.lit(1)).cast("double")
    spaces, breaks = n - F.length(F.replace(t, F.lit(" "), F.lit(""))), n - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    words, lines = F.split(t, " "), F.split(t, "\n")
    share = lambda pattern: F.regexp_count(t, F.lit(pattern)) / at_least_one
    return {
        "log_chars": F.log1p(n.cast("double")),
        "space_share": spaces / at_least_one,
        "word_length": n / (spaces + breaks + 1).cast("double"),
        "break_share": breaks / at_least_one,
        "upper_share": share(r"\p{Lu}"),
        "digit_share": share("[0-9]"),
        "symbol_share": share(r"[#$%&*@^~_=<>{}\\\[\]+]"),
        "bar_share": share(r"[|]"),
        "shout_share": share("[!?]"),
        "stop_share": share("[.,;:]"),
        "distinct_words": F.size(F.array_distinct(words)) / F.size(words).cast("double"),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
    }


NAMES = ["log_chars", "space_share", "word_length", "break_share", "upper_share", "digit_share", "symbol_share", "bar_share", "shout_share", "stop_share", "distinct_words", "distinct_lines"]


@dataclass(frozen=True)
class RuleModel:
    """score = logistic(bias + the weights of the rules that hold)."""

    bias: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def column(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def holds(rule: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for i, at_most, cut in rule:
        out = out & ((F.col(NAMES[i]) <= cut) if at_most else (F.col(NAMES[i]) > cut))
    return out


def paths(node, above: tuple[Condition, ...] = ()) -> Iterator[tuple[Condition, ...]]:
    """The conjunction that leads to every node of a fitted tree, without the root."""
    if above:
        yield above
    if node.getClass().getSimpleName() != "InternalNode":
        return
    split = node.split()
    i, cut = split.featureIndex(), split.threshold()
    yield from paths(node.leftChild(), (*above, (i, True, cut)))
    yield from paths(node.rightChild(), (*above, (i, False, cut)))


def tightened(rule: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """The same conjunction with one bound of each kind per statistic."""
    bounds: dict[tuple[int, bool], float] = {}
    for i, at_most, cut in rule:
        held = bounds.get((i, at_most), cut)
        bounds[i, at_most] = min(held, cut) if at_most else max(held, cut)
    return tuple(sorted((i, m, c) for (i, m), c in bounds.items()))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(k) for k, c in statistics(F.col("text")).items()])


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleModel:
    """Fit on at most ``sample`` labelled documents of each label outside the held-out fold (crc32 of the id modulo 4 is 2).

    The documents whose id hashes lowest are taken. Without both labels the model is a constant: their mean, or one half.
    """
    known = labels.where(F.col(label).isNotNull() & (fold_of("doc_id", 4) != 2)).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    picked = None
    for value in (0.0, 1.0):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    # a share of each label that is taken weighs the rows back to all labelled rows
    shares = known.groupBy("label").agg(F.count("*").alias("n")).select("label", (F.greatest(F.col("n"), F.lit(sample)) / sample).alias("weight"))
    rows = stats.join(F.broadcast(picked), "doc_id").join(F.broadcast(shares), "label")
    rows = staged(rows.orderBy(F.xxhash64("doc_id"), "doc_id").coalesce(4), "quality-sample")
    seen = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        mean = {0.0: -7.0, 1.0: 7.0}
        return RuleModel(mean[next(iter(seen))] if seen else 0.0, ())
    rows = rows.select("label", "weight", *NAMES, array_to_vector(F.array(*NAMES)).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, seed=17, labelCol="label", weightCol="weight", featureSubsetStrategy="sqrt").fit(rows)
    rules = sorted({tightened(r) for t in forest.trees for r in paths(t._call_java("rootNode"))})
    if not rules:
        return RuleModel(0.0, ())
    hits = rows.select("label", "weight", array_to_vector(F.array(*[F.when(holds(r), 1.0).otherwise(0.0) for r in rules])).alias("features"))
    fitted = LogisticRegression(regParam=lasso, elasticNetParam=1.0, maxIter=60, standardization=False, labelCol="label", weightCol="weight").fit(hits)
    return RuleModel(fitted.intercept, tuple((r, float(w)) for r, w in zip(rules, fitted.coefficients, strict=True) if abs(w) > 1e-9))


def score(stats: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null text counts as empty and has defined statistics; repeated rows are scored each; held_out is null for
    a null id; an empty table gives no rows; other columns are not read.
    """
    scored = stats.select("doc_id", model.column().alias("score"))
    return scored.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on the labels and score every document; the texts are read once."""
    stats = staged(with_statistics(docs), "statistics")
    return score(stats, fit(stats, labels, sample=sample), threshold)
