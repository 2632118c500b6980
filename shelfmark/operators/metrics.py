"""F1 by category and agreement of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.contracts import CATEGORIES, demand, violations


def _f1(true: Column, predicted: Column) -> Column:
    hit = F.count_if((true == 1) & (predicted == 1))
    parts = 2 * hit + F.count_if((true == 0) & (predicted == 1)) + F.count_if((true == 1) & (predicted == 0))
    return F.when(parts == 0, F.lit(0.0)).otherwise(2 * hit / parts)


def check_labels(df: DataFrame, *columns: str) -> None:
    bad = violations(df, {c: F.col(c).isNull() | ~F.col(c).isin(0, 1) for c in columns})
    demand([f"{c} has {n} values outside 0/1" for c, n in bad.items()], "labels")


def binary_f1(df: DataFrame, true: str = "true_label", predicted: str = "prediction") -> DataFrame:
    """One row f1: 2 TP / (2 TP + FP + FN), 0 where that is 0 / 0."""
    return df.agg(_f1(F.col(true), F.col(predicted)).alias("f1"))


def category_f1(df: DataFrame, true: str = "true_label", predicted: str = "prediction") -> DataFrame:
    """category, f1."""
    return df.groupBy("category").agg(_f1(F.col(true), F.col(predicted)).alias("f1"))


def mean_f1(df: DataFrame, categories: Sequence[str] = CATEGORIES, true: str = "true_label", predicted: str = "prediction") -> DataFrame:
    """One row: f1 of each category as f1_0, f1_1, ... and their mean; an absent or other category raises."""
    check_labels(df, true, predicted)
    there = {r.category for r in df.select("category").distinct().limit(len(categories) + 1).collect()}
    demand([f"category is absent: {c}" for c in categories if c not in there] + [f"unsupported category: {c}" for c in there if c not in categories], "metric")
    each = [_f1(F.when(F.col("category") == c, F.col(true)), F.when(F.col("category") == c, F.col(predicted))).alias(f"f1_{i}") for i, c in enumerate(categories)]
    names = [f"f1_{i}" for i in range(len(categories))]
    return df.agg(*each).select(*names, (sum(F.col(n) for n in names) / len(names)).alias("mean_f1"))


def votes(oof: DataFrame) -> DataFrame:
    """oof with word, char and logreg decisions, their majority and whether they disagree."""
    decided = oof.withColumns({"word_svc": (F.col("word_svc_margin") >= 0).cast("int"), "char_svc": (F.col("char_svc_margin") >= 0).cast("int"), "logistic_regression": (F.col("text_logreg_probability") >= 0.5).cast("int")})
    w, c, g = (F.col(x) for x in ("word_svc", "char_svc", "logistic_regression"))
    return decided.withColumns({"majority_vote": (w + c + g >= 2).cast("int"), "disagree": ~((w == c) & (c == g))})


MODELS = ("word_svc", "char_svc", "logistic_regression", "majority_vote")


def evaluate(oof: DataFrame) -> DataFrame:
    """model, category, f1 of the three models and their majority; one pass."""
    long = votes(oof).select("category", "true_label", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("prediction")) for m in MODELS])).alias("v"))
    return long.groupBy(F.col("v.model").alias("model"), "category").agg(_f1(F.col("true_label"), F.col("v.prediction")).alias("f1"))


def disagreement(oof: DataFrame) -> DataFrame:
    """category, share of rows on which the three models disagree."""
    return votes(oof).groupBy("category").agg(F.avg(F.col("disagree").cast("int")).alias("share"))
