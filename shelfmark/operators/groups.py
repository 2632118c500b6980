"""Duplicate groups: by text, then merged along trusted image pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.contracts import CATEGORIES, GROUPS, LABELS, conform, demand, id_differences, repeated, require_columns, violations
from shelfmark.functions.text import SEPARATOR, normalized_text, signature, stable_id
from shelfmark.operators.components import connected_components
from shelfmark.sources.scratch import materialise


def validate_source(df: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> None:
    require_columns(df, ("id", "name", "description", "category", "label"), "source")
    if df.isEmpty():
        raise ValueError("source: no rows")
    rules = {f"null {c}": F.col(c).isNull() for c in ("id", "category", "label")}
    rules |= {"unknown category": ~F.col("category").isin(*categories), "label outside 0/1": ~F.col("label").isin(*LABELS)}
    problems = [f"{name}: {n} rows" for name, n in violations(df, rules).items()]
    if n := repeated(df, ["id"]):
        problems.append(f"duplicate id: {n}")
    demand(problems, "source")


def _conflicts(rows: DataFrame) -> DataFrame:
    """(group_id, category, label_conflict): more than one label within a group's category."""
    return rows.groupBy("group_id", "category").agg((F.countDistinct("label") > 1).alias("label_conflict"))


def text_groups(df: DataFrame) -> DataFrame:
    """GROUPS by normalised name and description, whatever the category.

    A group of one row is unique; of rows equal before normalising, exact; else normalized.  Keys are written to the shared
    folder, so that what follows reads no text.
    """
    keyed = df.select("id", "category", "label", stable_id(signature(normalized_text("name"), normalized_text("description"))).alias("group_id"), F.sha2(signature("name", "description", null="<NULL>"), 256).alias("raw"))
    keyed = materialise(keyed, "keys")  # it is read several times, and texts are normalised once
    sizes = keyed.groupBy("group_id").agg(F.count("*").alias("group_size"), F.countDistinct("raw").alias("variants"))
    kind = F.when(F.col("group_size") == 1, "unique").when(F.col("variants") == 1, "exact").otherwise("normalized")
    sizes = sizes.select("group_id", "group_size", kind.alias("duplicate_kind"))
    return conform(keyed.join(sizes, "group_id").join(_conflicts(keyed), ["group_id", "category"]), GROUPS)


def check_collisions(df: DataFrame) -> None:
    """Raise if two different fingerprints have one id."""
    text = signature(normalized_text("name"), normalized_text("description"))
    r = df.select(F.sha2(text, 512).alias("t"), stable_id(text).alias("g")).agg(F.countDistinct("t").alias("t"), F.countDistinct("g").alias("g")).first()
    if r.t != r.g:
        raise RuntimeError("fingerprints collide")


def validate_groups(groups: DataFrame, source: DataFrame) -> None:
    require_columns(groups, GROUPS.names, "groups")
    problems = [f"{n} ids repeat" for n in [repeated(groups, ["id"])] if n]
    if not id_differences(source, groups).isEmpty():
        problems.append("ids differ from the source")
    if violations(groups, {"null": F.col("group_id").isNull()}):
        problems.append("null group_id")
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n"), F.min("group_size").alias("lo"), F.max("group_size").alias("hi"))
    if not sizes.filter("lo <> hi").isEmpty():
        problems.append("group_size varies within a group")
    if not sizes.filter("lo <> n or hi <> n").isEmpty():
        problems.append("recorded size differs from actual group size")
    demand(problems, "groups")


def merge_visual(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """GROUPS after joining text groups along auto_merge pairs, transitively.

    A group no pair touches keeps id and kind.  A merged one is named after its sorted members and is visual if all its
    members were unique, else mixed.  Sizes and conflicts are counted anew.
    """
    edges = pairs.filter("auto_merge").select("left_id", "right_id")
    ids = groups.select("id", "group_id")
    unknown = edges.select(F.col("left_id").alias("id")).union(edges.select("right_id")).join(ids, "id", "left_anti")
    if not unknown.isEmpty():
        raise ValueError("visual pairs hold unknown ids")
    left, right = (ids.select(F.col("id").alias(f"{s}_id"), F.col("group_id").alias(c)) for s, c in (("left", "a"), ("right", "b")))
    parts = connected_components(edges.join(left, "left_id").join(right, "right_id").select("a", "b").distinct(), lambda df: materialise(df, "groups"))
    kinds = groups.select("group_id", "duplicate_kind").distinct()
    whole = parts.union(parts.select("component", "component").distinct()).distinct().toDF("group_id", "component").join(kinds, "group_id")
    named = whole.groupBy("component").agg(
        stable_id(F.concat(F.lit("visual" + SEPARATOR), F.array_join(F.array_sort(F.collect_set("group_id")), SEPARATOR))).alias("new_id"),
        F.when(F.bool_and(F.col("duplicate_kind") == "unique"), "visual").otherwise("mixed").alias("new_kind"),
    )
    renamed = whole.select("group_id", "component").join(named, "component").drop("component")
    rows = groups.join(renamed, "group_id", "left").select(
        "id", "category", "label", F.coalesce("new_id", "group_id").alias("group_id"), F.coalesce("new_kind", "duplicate_kind").alias("duplicate_kind")
    )
    sizes = rows.groupBy("group_id").agg(F.count("*").alias("group_size"))
    return conform(rows.join(sizes, "group_id").join(_conflicts(rows), ["group_id", "category"]), GROUPS)


def label_conflicts(groups: DataFrame) -> DataFrame:
    """Rows in conflict, by group, category and id."""
    return groups.filter("label_conflict").orderBy("group_id", "category", "id")


def group_kinds(groups: DataFrame) -> DataFrame:
    """duplicate_kind, groups, rows."""
    return groups.groupBy("duplicate_kind").agg(F.countDistinct("group_id").alias("groups"), F.count("*").alias("rows"))


def group_summary(groups: DataFrame) -> DataFrame:
    """One row: groups, largest_group, conflicting_pairs of group and category, conflicting_rows."""
    pairs = groups.groupBy("group_id", "category").agg(F.count("*").alias("n"), F.bool_or("label_conflict").alias("c"), F.max("group_size").alias("s"))
    return pairs.agg(
        F.countDistinct("group_id").alias("groups"),
        F.max("s").alias("largest_group"),
        F.count_if("c").alias("conflicting_pairs"),
        F.coalesce(F.sum(F.when(F.col("c"), F.col("n"))), F.lit(0)).alias("conflicting_rows"),
    )


def largest_groups(groups: DataFrame, n: int = 15) -> DataFrame:
    """A report: the n largest groups of more than one row."""
    return groups.filter("group_size > 1").select("group_id", "group_size", "duplicate_kind").distinct().orderBy(F.desc("group_size"), "group_id").limit(n)
