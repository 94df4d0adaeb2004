"""Quality classifier: a sparse ensemble of rules over statistics of a text."""

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qarun.llm.common import Kept, as_text

# Marks that prose holds few of.
MARKS = "#$%&*|<>{}=~^@_\\\\\\[\\]"


def statistics(text: Column) -> dict[str, Column]:
    """Numbers about a whole text, each without an upper bound on its length."""
    words = F.split(F.btrim(text), r"\s+")
    chars = F.greatest(F.char_length(text), F.lit(1)).cast("double")
    n_words = F.size(words).cast("double")
    lines = F.split(text, "\n")
    marks, letters = F.regexp_count(text, F.lit(f"[{MARKS}]")), F.regexp_count(text, F.lit(r"\p{L}"))
    return {
        "words": n_words,
        "chars_per_word": chars / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "repeats": F.regexp_count(text, F.lit(r"(?<!\S)(\S+)\s+(?=\1(?:\s|\z))")) / n_words,
        "marks_per_word": marks / n_words,
        "bars_per_word": F.regexp_count(text, F.lit(r"(?<!\S)\|(?!\S)")) / n_words,
        "shouts_per_word": F.regexp_count(text, F.lit("!")) / n_words,
        "letters": letters / chars,
        "capitals": F.regexp_count(text, F.lit(r"\p{Lu}")) / F.greatest(letters, F.lit(1)),
        "digits": F.regexp_count(text, F.lit("[0-9]")) / chars,
        "stops_per_word": F.regexp_count(text, F.lit("[.?]")) / n_words,
        "commas_per_word": F.regexp_count(text, F.lit(",")) / n_words,
        "words_per_line": n_words / F.size(lines),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }


class Condition(NamedTuple):
    """``statistic <= bound``, or ``>`` where ``above``."""

    statistic: str
    above: bool
    bound: float

    def column(self) -> Column:
        value, bound = F.col(self.statistic), F.lit(self.bound)
        return value > bound if self.above else value <= bound


Rule = tuple[Condition, ...]


def rule_column(rule: Rule) -> Column:
    """Whether all conditions of a rule hold."""
    first, *more = [condition.column() for condition in rule]
    for condition in more:
        first = first & condition
    return first


class Model(NamedTuple):
    """Rules with weights, and a bias."""

    rules: tuple[tuple[Rule, float], ...]
    bias: float

    def score(self) -> Column:
        """The chance of label 1 as an expression over the columns of ``statistics``."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(rule_column(rule), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _paths(node, names: list[str], path: Rule = ()) -> Iterator[Rule]:
    """Every path from the root of a tree to a node below it."""
    if path:
        yield path
    if node.subtreeDepth() == 0:
        return
    split = node.split()
    for above, child in ((False, node.leftChild()), (True, node.rightChild())):
        condition = Condition(names[split.featureIndex()], above, float(split.threshold()))
        yield from _paths(child, names, (*path, condition))


def _simplified(rule: Rule) -> Rule:
    """At most one condition per statistic and side: the strictest."""
    strictest: dict[tuple[str, bool], float] = {}
    for statistic, above, bound in rule:
        pick = max if above else min
        strictest[statistic, above] = pick(bound, strictest.get((statistic, above), bound))
    return tuple(sorted(Condition(s, above, bound) for (s, above), bound in strictest.items()))


def fit(
    labelled: DataFrame,
    label: str = "label",
    max_rows: int = 50_000,
    trees: int = 12,
    depth: int = 3,
    lasso: float = 0.0005,
) -> Model:
    """Fit on a table with the columns of ``statistics``, ``id`` and ``label`` (0 or 1).

    At most about ``max_rows`` of its rows are taken, by a hash of the id. The paths of a
    random forest become rules; a logistic model with a lasso penalty weighs them, and only
    rules with a weight stay. Other labels and null labels are left out. Without rows
    of both labels the model is constant.
    """
    names = list(statistics(F.lit("")))
    known = labelled.filter(F.col(label).isin(0, 1))
    n = known.count()
    part = int(min(1.0, max_rows / max(n, 1)) * (1 << 20))
    kept = Kept(labelled.sparkSession)
    rows = kept.keep(
        known.filter(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 20)) < part).select(
            *names, F.col(label).cast("double").alias("label")
        ),
        "quality-sample",
    )
    found = {row.label for row in rows.select("label").distinct().collect()}
    if len(found) < 2:
        return Model((), 20.0 if found == {1.0} else -20.0)
    vectors = rows.select(array_to_vector(F.array(*names)).alias("features"), "label")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7).fit(vectors)
    rules = sorted(
        {
            _simplified(path)
            for tree in forest.trees
            for path in _paths(tree._java_obj.rootNode(), names)
        }
    )
    held = F.array(*[rule_column(rule).cast("double") for rule in rules])
    matrix = kept.keep(rows.select(held.alias("held"), "label"), "quality-rules")
    weighed = LogisticRegression(
        regParam=lasso, elasticNetParam=1.0, standardization=False, maxIter=100
    ).fit(matrix.select(array_to_vector("held").alias("features"), "label"))
    weights = weighed.coefficients.toArray()
    chosen = tuple((rule, float(w)) for rule, w in zip(rules, weights, strict=True) if w)
    return Model(chosen, float(weighed.intercept))


def with_statistics(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and the statistics of every row's whole text; null counts as empty."""
    value = as_text(text)
    return docs.select(F.col(id).alias("id"), *[c.alias(n) for n, c in statistics(value).items()])


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    id: str = "doc_id",
    text: str = "text",
    **options,
) -> DataFrame:
    """Learn from ``labels`` (id and label) and score every row: ``doc_id, score``.

    The statistics are taken once and written; fitting and scoring read them instead of the
    texts. Null and empty texts are scored like others. Rows with a null id are scored but
    not learnt from; repeated rows and labels count as often as they occur. Empty tables give
    no rows and a constant model. ``options`` are those of ``fit``.
    """
    kept = Kept(docs.sparkSession)
    rows = kept.keep(with_statistics(docs, id, text), "statistics")
    marked = labels.select(F.col(id).alias("id"), F.col(label).alias("label"))
    model = fit(rows.join(marked, "id"), **options)
    return rows.select(F.col("id").alias("doc_id"), model.score().alias("score"))
