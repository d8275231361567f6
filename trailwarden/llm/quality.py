"""Quality by a sparse rule ensemble.

Statistics of a text are Spark column expressions.  Shallow trees grown on them
give paths, every path is a conjunctive rule, a lasso-penalised logistic
regression weighs the rules (most weights become zero), and the surviving rules
are compiled back to one column expression: scoring is a projection, without
Python and without a shuffle.

Trees and weights are learned from a sample of at most ``max_rows`` labelled rows.

Defined results: a null or empty text has the statistics of an empty text (all
zero) and gets the rules' score for them; without any usable label of both kinds
there are no rules and every score is 1 (nothing is called poor without
evidence); repeated rows are scored each; other columns are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, staged
from .labelled import fold, training_rows

MAX_ROWS = 8_000
TREES = 12
DEPTH = 3
LASSO = 0.002

Condition = tuple[str, str, float]  # statistic, "<=" or ">", bound


def reductions(text: Column) -> dict[str, Column]:
    """The few passes over a whole text; everything else is counted in what they leave.  ``text`` must not be null."""
    return {
        "_chars": F.length(text),
        "_marks": F.regexp_replace(text, "[a-zA-Z]+", ""),
        "_capitals": F.length(F.regexp_replace(text, "[^A-Z]+", "")),
        "_words": F.split(F.lower(text), r"\s+"),
        "_lines": F.split(text, "\n"),
    }


def statistics() -> dict[str, Column]:
    """Name to expression over the columns of ``reductions``."""
    marks, words, lines = F.col("_marks"), F.col("_words"), F.col("_lines")
    per_char = F.greatest(F.col("_chars"), F.lit(1)).cast("double")
    per_word, per_line = F.size(words).cast("double"), F.size(lines).cast("double")

    def count_of(characters: str) -> Column:
        return (F.length(marks) - F.length(F.regexp_replace(marks, f"[{characters}]+", ""))).cast("double")

    return {
        "chars": F.log1p(F.col("_chars").cast("double")),
        "words": F.log1p(per_word),
        "word_length": F.col("_chars") / per_word,
        "other_than_letters": F.length(marks) / per_char,
        "digits": count_of("0-9") / per_char,
        "capitals": F.col("_capitals") / per_char,
        "exclamations": count_of("!") / per_word,
        "bars": count_of("|") / per_word,
        "signs": count_of(r"#$%&*@^~<>{}\[\]\\/=_+") / per_word,
        "stops": count_of(".?!") / per_word,
        "commas": count_of(",;") / per_word,
        "distinct_words": F.size(F.array_distinct(words)) / per_word,
        "distinct_lines": F.size(F.array_distinct(lines)) / per_line,
        "line_length": F.log1p(F.col("_chars") / per_line),
    }


def with_statistics(rows: DataFrame) -> DataFrame:
    """``_s_<name>`` columns in place of ``text``; the reductions are computed once, below the statistics."""
    others = [F.col(c) for c in rows.columns if c != "text"]
    reduced = rows.select(*others, *[e.alias(n) for n, e in reductions(F.col("text")).items()])
    return reduced.select(*others, *[e.cast("double").alias(f"_s_{n}") for n, e in statistics().items()])


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[float, tuple[Condition, ...]], ...]

    def column(self) -> Column:
        """Score over the columns of ``with_statistics``."""
        if not self.rules and self.intercept == float("inf"):
            return F.lit(1.0)
        total = F.lit(self.intercept)
        for weight, conditions in self.rules:
            total = total + F.when(rule_column(conditions), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def rule_column(conditions: tuple[Condition, ...]) -> Column:
    holds = F.lit(True)
    for name, side, bound in conditions:
        c = F.col(f"_s_{name}")
        holds = holds & ((c <= bound) if side == "<=" else (c > bound))
    return holds


_SPLIT = re.compile(r"^(\s*)(If|Else) \(feature (\d+) (<=|>) (\S+)\)")


def tree_paths(description: str, names: list[str]) -> set[tuple[Condition, ...]]:
    """Every path from a root to any node below it, from Spark's text form of a tree ensemble."""
    found: set[tuple[Condition, ...]] = set()
    path: list[tuple[int, Condition]] = []
    for line in description.splitlines():
        if "Tree " in line:
            path = []
        if m := _SPLIT.match(line):
            depth = len(m[1])
            while path and path[-1][0] >= depth:
                path.pop()
            path.append((depth, (names[int(m[3])], m[4], float(m[5]))))
            found.add(_tightest([c for _, c in path]))
    return found


def _tightest(conditions: list[Condition]) -> tuple[Condition, ...]:
    """One bound per statistic and side."""
    best: dict[tuple[str, str], float] = {}
    for name, side, bound in conditions:
        held = best.get((name, side))
        best[name, side] = bound if held is None else (min if side == "<=" else max)(held, bound)
    return tuple(sorted((n, s, b) for (n, s), b in best.items()))


def fit(training: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = 11) -> RuleModel:
    """Learn from ``text, label`` rows, bounded by the caller."""
    rows = staged(with_statistics(training.select("text", F.col("label").cast("double").alias("label"))), "quality-training")
    if rows.select("label").distinct().count() < 2:
        return RuleModel(float("inf"), ())
    names = [c.removeprefix("_s_") for c in rows.columns if c.startswith("_s_")]
    assembled = VectorAssembler(inputCols=[f"_s_{n}" for n in names], outputCol="_features").transform(rows)
    forest = RandomForestClassifier(labelCol="label", featuresCol="_features", numTrees=trees, maxDepth=depth, seed=seed,
                                    featureSubsetStrategy="onethird", minInstancesPerNode=10).fit(assembled)
    rules = sorted(tree_paths(forest.toDebugString, names))
    if not rules:
        return RuleModel(float("inf"), ())
    held = rows.select("label", F.array(*[rule_column(r).cast("double") for r in rules]).alias("_rules"))
    fired = held.select("label", array_to_vector("_rules").alias("_features"))
    lasso_fit = LogisticRegression(labelCol="label", featuresCol="_features", elasticNetParam=1.0, regParam=lasso,
                                   standardization=False, maxIter=100).fit(fired)
    weights = lasso_fit.coefficients.toArray().tolist()
    return RuleModel(float(lasso_fit.intercept), tuple((w, r) for w, r in zip(weights, rules) if w != 0.0))


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score``: one row per input row, a projection."""
    return with_statistics(id_text(docs, id_col, text_col)).select("doc_id", model.column().alias("score"))


def keep_good(docs: DataFrame, model: RuleModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` (all columns as they are) that score ``threshold`` or more."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    scored = with_statistics(docs.select(whole.alias("_row"), text.alias("text")))
    # the row number keeps the filter above the projection; below it, every rule would count its statistics again
    once = scored.select("_row", model.column().alias("_score"), F.monotonically_increasing_id().alias("_number"))
    return once.where((F.col("_score") >= threshold) & (F.col("_number") >= 0)).select("_row.*")


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 4, held_out: int = 2,
          max_rows: int = MAX_ROWS) -> RuleModel:
    return fit(training_rows(docs, labels, label_col, folds, held_out, max_rows))


def predictions(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """Contract form."""
    scored = score(docs, learn(docs, labels, folds=folds, held_out=held_out))
    return scored.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
