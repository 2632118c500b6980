"""The product manifest: source, groups, folds and image counts in one frozen table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.contracts import MANIFEST, check_alignment, check_schema, conform, demand, repeated, same_rows, violations
from shelfmark.functions.text import normalized_text
from shelfmark.operators.folds import leaks


def image_counts(images: DataFrame, source: DataFrame) -> DataFrame:
    """(id, image_count) of readable images in the dataset; an id marked so but unknown to the source raises."""
    mine = images.filter("in_dataset")
    if not mine.select("id").join(source.select("id"), "id", "left_anti").isEmpty():
        raise ValueError("images: in_dataset ids are unknown to the source")
    return mine.filter("status = 'ok'").groupBy("id").agg(F.count("*").alias("image_count"))


def product_manifest(source: DataFrame, groups: DataFrame, folds: DataFrame, images: DataFrame) -> DataFrame:
    """MANIFEST: every source row once, 0 images where none counts."""
    text = source.select("id", "name", "description", "category", "label", normalized_text("name").alias("normalized_name"), normalized_text("description").alias("normalized_description"))
    group = groups.select("id", "group_id", F.col("duplicate_kind").alias("duplicate_type"), "label_conflict")
    joined = text.join(group, "id", "left").join(folds.select("id", "fold"), "id", "left").join(image_counts(images, source), "id", "left")
    return conform(joined.withColumn("image_count", F.coalesce("image_count", F.lit(0))), MANIFEST)


def validate_inputs(source: DataFrame, groups: DataFrame, folds: DataFrame) -> None:
    check_alignment(source, groups, what="source and groups")
    check_alignment(source, folds, what="source and folds")


def validate_manifest(manifest: DataFrame, source: DataFrame, groups: DataFrame, folds: DataFrame, images: DataFrame) -> None:
    """Everything derived is derived again and compared."""
    check_schema(manifest, MANIFEST, "manifest")
    derived = ("normalized_name", "normalized_description", "group_id", "duplicate_type", "label_conflict", "image_count", "fold")
    problems = [f"null {c}: {n}" for c, n in violations(manifest, {c: F.col(c).isNull() for c in derived}).items()]
    if n := repeated(manifest, ["id"]):
        problems.append(f"{n} ids repeat")
    if not leaks(manifest).isEmpty():
        problems.append("a group is in several folds")
    if not problems and not same_rows(manifest, product_manifest(source, groups, folds, images)):
        problems.append("values differ from their inputs")
    demand(problems, "manifest")


def count_distribution(manifest: DataFrame) -> DataFrame:
    """One row: min, median, mean and max images of a product that has any."""
    some = manifest.filter("image_count > 0")
    return some.agg(F.min("image_count").alias("least"), F.median("image_count").alias("median"), F.avg("image_count").alias("mean"), F.max("image_count").alias("most"))
