"""Profile of a product table: domains, balance, gaps, duplicates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.contracts import CATEGORIES, LABELS, PRODUCTS, require_columns
from shelfmark.functions.text import blank, normalized_text, signature
from shelfmark.sources.scratch import materialise

REQUIRED = tuple(f.name for f in PRODUCTS)


def class_balance(df: DataFrame) -> DataFrame:
    """category, label, n and n's share of the category."""
    counts = df.groupBy("category", "label").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("category")))


def missing_values(df: DataFrame, columns: Sequence[str] = ("name", "description")) -> DataFrame:
    """One row per column: nulls, and texts of white space only.  One pass."""
    row = df.agg(*[F.struct(F.count_if(F.col(c).isNull()).alias("nulls"), F.count_if(blank(c)).alias("blanks")).alias(c) for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}.nulls").alias("nulls"), F.col(f"{c}.blanks").alias("blanks")) for c in columns]))
    return row.select(each.alias("r")).select("r.*")


def null_counts(df: DataFrame) -> DataFrame:
    """One row: nulls of every column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def profile(df: DataFrame, categories: Sequence[str] = CATEGORIES, labels: Sequence[int] = LABELS) -> DataFrame:
    """One row: rows, unique_ids (null counts as a value), duplicate_id_rows, unknown_categories, invalid_labels.

    Unknown or invalid are rows whose value is outside the domain, null included.
    """
    require_columns(df, REQUIRED, "products")
    ids = df.groupBy("id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("category").isNull() | ~F.col("category").isin(*categories)).alias("c"),
        F.count_if(F.col("label").isNull() | ~F.col("label").isin(*labels)).alias("l"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return ids.agg(
        total("n").alias("rows"),
        F.count("*").alias("unique_ids"),
        total(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("duplicate_id_rows"),
        total("c").alias("unknown_categories"),
        total("l").alias("invalid_labels"),
    )


def unexpected_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in REQUIRED]


def index_like_columns(df: DataFrame) -> list[str]:
    """Integer columns outside the contract that hold 0 to n - 1 once each, in any order of rows."""
    names = [c for c, t in df.dtypes if c not in REQUIRED and t in ("bigint", "int", "smallint", "tinyint")]
    found = []
    for c in names:
        r = df.agg(F.count("*").alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.countDistinct(c).alias("d"), F.count(c).alias("k")).first()
        if r.n and r.lo == 0 and r.hi == r.n - 1 and r.d == r.k == r.n:
            found.append(c)
    return found


def _duplicates(df: DataFrame, texts: dict[str, Column], raw: Column) -> DataFrame:
    """Groups of more than one row equal in category and texts; labels keep null as a value of its own, last.

    Rows meet by the digest of their texts, which is made once and written to the shared folder.  The texts of a group are
    those of its row with the least id, joined back once for each group by id and the digest of raw; a group's rows, however
    many, are counted before they meet.
    """
    key, mark = F.sha2(_whole(texts.values()), 256), F.sha2(raw, 256)
    rows = materialise(df.select("id", "category", "label", "name", key.alias("_key"), mark.alias("_raw")), "digests")
    parts = rows.groupBy("category", "_key", "_raw").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("category", "_key").agg(F.sum("n").alias("size"), F.count("*").alias("raw_variants")).filter("size > 1")
    labels = F.array_sort(F.collect_set(F.struct(F.col("label").isNull().alias("none"), F.col("label").alias("v"))))
    own = rows.join(sizes.select(F.col("category").alias("_c"), F.col("_key").alias("_k")), F.col("category").eqNullSafe(F.col("_c")) & (F.col("_key") == F.col("_k")), "left_semi")
    lists = own.groupBy("category", "_key").agg(F.array_sort(F.collect_list("id")).alias("ids"), labels.alias("_l"), F.array_sort(F.collect_set("name")).alias("name_variants"), F.min(F.struct("id", "_raw")).alias("_first"))
    one = df.select(F.col("id").alias("_id"), mark.alias("_mark"), "name", "description")
    same = F.col("a.category").eqNullSafe(F.col("b.category")) & (F.col("a._key") == F.col("b._key"))
    met = lists.alias("a").join(sizes.alias("b"), same).select("a.*", "b.size", "b.raw_variants")
    met = met.join(one, F.col("_first.id").eqNullSafe(F.col("_id")) & (F.col("_first._raw") == F.col("_mark"))).dropDuplicates(["category", "_key"])
    return met.select("category", *[t.alias(n) for n, t in texts.items()], "size", "raw_variants", "ids", "name_variants", F.transform("_l", lambda x: x["v"]).alias("labels"), (F.size("_l") > 1).alias("label_conflict"))


def _whole(texts: Iterable[Column]) -> Column:
    """The texts as one, null and empty told apart."""
    return F.concat_ws("", *[F.when(t.isNull(), "-").otherwise(F.concat(F.lit("+"), F.length(t).cast("string"), F.lit(":"), t)) for t in texts])


def exact_duplicates(df: DataFrame) -> DataFrame:
    """Rows equal in category, name and description: size, ids, labels, label_conflict."""
    texts = {"name": F.col("name"), "description": F.col("description")}
    return _duplicates(df, texts, _whole(texts.values())).drop("raw_variants", "name_variants")


def near_duplicates(df: DataFrame) -> DataFrame:
    """Rows equal after normalising but not all equal before: also raw_variants and name_variants."""
    texts = {"normalized_name": normalized_text("name"), "normalized_description": normalized_text("description")}
    return _duplicates(df, texts, signature("name", "description")).filter("raw_variants > 1")


def duplicate_counters(groups: DataFrame) -> DataFrame:
    """One row: groups, rows, extra_rows, conflicting groups."""
    return groups.agg(
        F.count("*").alias("groups"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("extra_rows"),
        F.count_if("label_conflict").alias("conflicting"),
    )
