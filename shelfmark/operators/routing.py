"""Which products take which costly stages, and decisions on what came back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.contracts import AVAILABILITY, demand
from shelfmark.sources.scratch import materialise

#: Stages that each route runs.
ROUTES = {"A": (), "B": ("ocr", "embeddings", "retrieval"), "C": ("ocr", "embeddings", "retrieval", "lora")}
#: Columns that no stage may take as input: what is known only after the fact.
FORBIDDEN = ("true_label", "label", "quality_tier")


def route(images_help: Column, lora_helps: Column, images_from: float = 0.5, lora_from: float = 0.5) -> Column:
    """A: text only; B: with images; C: with images and the large model. The second router counts only after the first."""
    return F.when(images_help < images_from, "A").when(lora_helps < lora_from, "B").otherwise("C")


def simulate(rows: DataFrame, stage_columns: dict[str, list[str]]) -> DataFrame:
    """rows (with column route) with the columns of stages that the route skips as null, and the availability masks."""
    out = rows
    for stage, columns in stage_columns.items():
        ran = F.col("route").isin([r for r, stages in ROUTES.items() if stage in stages])
        out = out.withColumns({c: F.when(ran, F.col(c)) for c in columns} | {f"has_{stage}": ran.cast("byte")})
    return out.withColumns({m: F.lit(0).cast("byte") for m in AVAILABILITY if m not in out.columns})


def route_costs(rows: DataFrame, cost: dict[str, float]) -> DataFrame:
    """route, rows, share of all, total cost at the given seconds per row."""
    counts = rows.groupBy("route").agg(F.count("*").alias("rows"))
    each = F.coalesce(*[F.when(F.col("route") == r, F.lit(float(s))) for r, s in cost.items()])
    return counts.select("route", "rows", (F.col("rows") / F.sum("rows").over(Window.partitionBy())).alias("share"), (F.col("rows") * each).alias("cost"))


def check_inputs(columns: list[str], allowed: list[str]) -> None:
    """Raise for a column outside the allow-list, or one that is forbidden to every stage."""
    demand([f"forbidden input {c}" for c in columns if c in FORBIDDEN] + [f"input {c} is not allowed" for c in columns if c not in allowed and c not in FORBIDDEN], "router")


def check_fold_safe(pairs: DataFrame, folds: DataFrame, left: str = "id", right: str = "neighbor") -> None:
    """Raise if a row was compared with one of its own fold or group."""
    a = folds.select(F.col("id").alias(left), F.col("fold").alias("fa"), F.col("group_id").alias("ga"))
    b = folds.select(F.col("id").alias(right), F.col("fold").alias("fb"), F.col("group_id").alias("gb"))
    if not pairs.join(a, left).join(b, right).filter("fa = fb or ga = gb").isEmpty():
        raise ValueError("rows were compared within their fold or group")


def best_threshold(scores: DataFrame, score: str = "score", true: str = "true_label", parts: int = 1024) -> DataFrame:
    """category, threshold, f1: the score from which predicting 1 gives the best F1, the highest of equals.

    Scores are counted once per distinct value.  Distinct values are dealt into parts by their order; sums over whole
    parts, then over the values of each part, give the true and false positives of every threshold, so no task holds a
    category's values, however many there are.
    """
    by = materialise(scores.groupBy("category", F.col(score).alias("threshold")).agg(F.sum(true).alias("pos"), F.count("*").alias("n")), "thresholds")
    ends = by.groupBy("category").agg(F.min("threshold").alias("lo"), F.max("threshold").alias("hi"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("threshold") - F.col("lo")) / (F.col("hi") - F.col("lo")) * parts), F.lit(parts - 1))).otherwise(0)
    by = by.join(F.broadcast(ends), "category").withColumn("part", place.cast("int"))  # ends: a line for each category
    sums = by.groupBy("category", "part").agg(F.sum("pos").alias("part_pos"), F.sum("n").alias("part_n"))
    above = Window.partitionBy("category").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("category")
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = sums.select("category", "part", zero(F.sum("part_pos").over(above)).alias("pos_above"), zero(F.sum("part_n").over(above)).alias("n_above"), F.sum("part_pos").over(whole).alias("positives"))
    down = Window.partitionBy("category", "part").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    rows = by.join(F.broadcast(sums), ["category", "part"])  # sums: categories times parts
    tp, predicted, positives = F.col("pos_above") + F.sum("pos").over(down), F.col("n_above") + F.sum("n").over(down), F.col("positives")
    f1 = F.when(predicted + positives == 0, F.lit(0.0)).otherwise(2 * tp / (predicted + positives))
    return rows.select("category", "threshold", f1.alias("f1")).groupBy("category").agg(F.max(F.struct("f1", "threshold")).alias("b")).select("category", F.col("b.threshold").alias("threshold"), F.col("b.f1").alias("f1"))


def calibrated(scores: DataFrame, bins: int = 10, score: str = "score", true: str = "true_label") -> DataFrame:
    """category, bin, n, mean score, share of 1: how far scores between 0 and 1 can be read as probabilities."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    return scores.groupBy("category", at.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(true).alias("positive_share"))


def fit_calibrator(scores: DataFrame, bins: int = 1000, score: str = "score", true: str = "true_label") -> DataFrame:
    """category, bin, probability: the share of 1 as a non-decreasing function of scores between 0 and 1.

    Scores are counted in bins; neighbouring bins whose shares fall are pooled until none does.  The driver gets
    categories times bins lines.
    """
    counted = calibrated(scores, bins, score, true).select("category", "bin", "n", "positive_share").toPandas().sort_values(["category", "bin"])
    lines = []
    for category, own in counted.groupby("category"):
        pools: list[list[float]] = []  # share, rows, first bin
        for b, n, share in zip(own.bin.tolist(), own.n.tolist(), own.positive_share.tolist(), strict=True):
            pools.append([share, n, b])
            while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
                share, n, _ = pools.pop()
                held = pools[-1]
                held[0], held[1] = (held[0] * held[1] + share * n) / (held[1] + n), held[1] + n
        starts = [int(p[2]) for p in pools]
        for b in range(bins):
            at = max(0, sum(s <= b for s in starts) - 1)
            lines.append((category, b, float(pools[at][0])))
    return scores.sparkSession.createDataFrame(lines, "category string, bin long, probability double")


def apply_calibrator(scores: DataFrame, calibrator: DataFrame, bins: int = 1000, score: str = "score") -> DataFrame:
    """scores with probability; null for a category the calibrator has not seen, or a null score."""
    at = F.greatest(F.lit(0), F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)))
    return scores.withColumn("bin", F.when(F.col(score).isNotNull(), at)).join(F.broadcast(calibrator), ["category", "bin"], "left").drop("bin")


def quality_tier(has_human: Column, has_rule: Column, conflict: Column, agree: Column) -> Column:
    """How far a training row may be trusted: gold, silver_high, silver or label_only."""
    return F.when(has_human, "gold").when(has_rule & ~conflict & agree, "silver_high").when(has_rule & ~conflict, "silver").otherwise("label_only")
