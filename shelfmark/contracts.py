"""Frozen table schemas, and checks that raise ValueError with every problem named."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

CATEGORIES = ("БАД", "Легковоспламеняющиеся")
LABELS = (0, 1)

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "short": T.ShortType(), "byte": T.ByteType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(), "binary": T.BinaryType()}


def table(text: str) -> T.StructType:
    """A schema from "name type, name type"."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in text.split(","))])


#: The tables of the library; the order of columns is part of each contract.
PRODUCTS = table("id long, name string, description string, category string, label long")
GROUPS = table("id long, category string, label long, group_id string, group_size long, duplicate_kind string, label_conflict boolean")
FOLDS = table("id long, category string, label long, group_id string, fold byte")
IMAGES = table("id long, image_index long, relative_path string, extension string, format string, width long, height long, mode string, file_size_bytes long, in_dataset boolean, status string, error string")
IMAGE_HASHES = table("id long, image_index long, relative_path string, file_sha256 string, phash string, dhash string, width long, height long, status string, error string")
VISUAL_PAIRS = table(
    "left_id long, right_id long, left_path string, right_path string, match_kind string, exact_image_pairs long, strong_image_pairs long, candidate_image_pairs long,"
    "phash_distance short, dhash_distance short, aspect_ratio_delta double, primary_match boolean, auto_merge boolean"
)
MANIFEST = table(
    "id long, name string, description string, category string, label long, normalized_name string, normalized_description string, group_id string,"
    "duplicate_type string, label_conflict boolean, image_count long, fold byte"
)
BASE = table("id long, category string, fold byte, group_id string, true_label long")
#: Which later stages have run for a row.
AVAILABILITY = ("has_ocr", "has_embeddings", "has_retrieval", "has_lora")


def require_columns(df: DataFrame, names: Iterable[str], what: str = "table") -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what}: missing required columns: {', '.join(missing)}")


def check_schema(df: DataFrame, schema: T.StructType, what: str = "table") -> DataFrame:
    """df, if its columns have exactly these names, order and types."""
    own, want = [(f.name, f.dataType) for f in df.schema], [(f.name, f.dataType) for f in schema]
    if own != want:
        raise ValueError(f"{what}: schema differs: {own} instead of {want}")
    return df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df's columns in the contract's order, cast to its types; an impossible cast raises when run."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def violations(df: DataFrame, rules: dict[str, Column]) -> dict[str, int]:
    """How many rows break each rule; one aggregation for all rules."""
    if not rules:
        return {}
    row = df.agg(*[F.count_if(F.coalesce(broken, F.lit(False))).alias(str(i)) for i, broken in enumerate(rules.values())]).first()
    return {name: row[i] for i, name in enumerate(rules) if row[i]}


def repeated(df: DataFrame, keys: Sequence[str]) -> int:
    """How many key values more than one row has."""
    return df.groupBy(*keys).count().filter("count > 1").count()


def demand(problems: Iterable[str], what: str) -> None:
    found = list(problems)
    if found:
        raise ValueError(f"{what}: " + "; ".join(found))


def id_differences(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Ids of one side only: (key, side)."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(True)), right.select(key).distinct().withColumn("r", F.lit(True))
    both = a.join(b, key, "full").filter(F.col("l").isNull() | F.col("r").isNull())
    return both.select(key, F.when(F.col("l").isNull(), "right").otherwise("left").alias("side"))


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether both tables hold the same rows equally often."""
    return left.columns == right.columns and left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def join_one_to_one(left: DataFrame, right: DataFrame, key: str = "id", what: str = "tables") -> DataFrame:
    """Inner join in which each key stands once on either side and no side has keys of its own."""
    problems = [f"{side} repeats {n} of its ids" for side, df in (("left", left), ("right", right)) if (n := repeated(df, [key]))]
    if not id_differences(left, right, key).isEmpty():
        problems.append("id sets differ")
    demand(problems, what)
    return left.join(right, key)


def check_alignment(source: DataFrame, other: DataFrame, columns: Sequence[str] = ("category", "label"), what: str = "tables") -> None:
    """The same ids once each, with equal values in columns."""
    joined = join_one_to_one(source.select("id", *columns), other.select("id", *[F.col(c).alias(f"_{c}") for c in columns]), what=what)
    differ = joined.filter(~F.expr(" and ".join(f"{c} <=> _{c}" for c in columns)))
    demand([] if differ.isEmpty() else [f"{'/'.join(columns)} values differ"], what)
