"""Markdown reports: aggregates from Spark, rendered on the driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from shelfmark.functions import signals as S
from shelfmark.functions.numbers import truncated
from shelfmark.operators import audit, checksum, folds, groups, images, manifest, metrics, rules

#: Rows of a report's list at most.
ROWS = 15


def percent(x: float | None) -> str:
    return "–" if x is None else f"{100 * x:.2f} %"


def cell(value: object) -> str:
    text = "" if value is None else f"{value:.6g}" if isinstance(value, float) else str(value)
    return text.replace("|", "\\|").replace("\n", " ")


def grid(df: DataFrame, most: int = ROWS) -> str:
    """A Markdown table of the first rows of a small result."""
    rows = df.limit(most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)])


def page(title: str, sections: Sequence[tuple[str, str]]) -> str:
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{body}" for name, body in sections)]) + "\n"


def audit_report(df: DataFrame) -> str:
    exact, near = audit.exact_duplicates(df), audit.near_duplicates(df)
    shown = near.select("category", truncated("normalized_name").alias("name"), "size", "raw_variants", "label_conflict", F.element_at("ids", 1).alias("first_id"))
    return page(
        "Audit",
        [
            ("Profile", grid(audit.profile(df))),
            ("Columns outside the contract", ", ".join(audit.unexpected_columns(df)) or "none"),
            ("Like an index", ", ".join(audit.index_like_columns(df)) or "none"),
            ("Classes", grid(audit.class_balance(df).orderBy("category", "label"))),
            ("Gaps", grid(audit.missing_values(df))),
            ("Exact duplicates", grid(audit.duplicate_counters(exact))),
            ("Near duplicates", grid(audit.duplicate_counters(near))),
            ("Largest near-duplicate groups", grid(shown.orderBy(F.desc("size"), "first_id"))),
        ],
    )


def group_report(g: DataFrame) -> str:
    return page("Groups", [("Kinds", grid(groups.group_kinds(g).orderBy("duplicate_kind"))), ("Summary", grid(groups.group_summary(g))), ("Largest", grid(groups.largest_groups(g))), ("Conflicts", grid(groups.label_conflicts(g)))])


def fold_report(f: DataFrame) -> str:
    sizes = f.groupBy("fold").agg(F.count("*").alias("rows"), F.countDistinct("group_id").alias("groups")).orderBy("fold")
    return page("Folds", [("Sizes", grid(sizes)), ("Balance", grid(folds.fold_balance(f).orderBy("category", "label", "fold"), 100)), ("Largest deviation", percent(folds.max_deviation(f).first().max_deviation)), ("Checksum", checksum.ordered_checksum(f))])


def image_report(i: DataFrame, ids: DataFrame) -> str:
    kinds = i.groupBy("extension", "status").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "extension", "status")
    return page("Images", [("Coverage", grid(images.coverage(i, ids))), ("Kinds", grid(kinds)), ("Frequent sizes", grid(images.top_sizes(i))), ("Unreadable", grid(i.filter("status = 'error'").select("relative_path", "error").orderBy("relative_path")))])


def manifest_report(m: DataFrame) -> str:
    kinds = m.groupBy("duplicate_type").agg(F.count("*").alias("rows")).orderBy("duplicate_type")
    return page("Manifest", [("Duplicate types", grid(kinds)), ("Images of a product", grid(manifest.count_distribution(m))), ("Checksum", checksum.ordered_checksum(m))])


def contract_report() -> str:
    """The evidence contract as text."""
    lines = []
    for category, fields in S.FIELDS.items():
        lines.append((category, "\n".join([*(f"- {f}: {', '.join(str(v).lower() if isinstance(v, bool) else v for v in values)}" for f, values in fields.items()), f"- rules: {', '.join(S.RULE_IDS[category])}"])))
    return page("Evidence", lines)


def rule_report(f: DataFrame) -> str:
    return page("Text rules", [("Coverage", grid(rules.rule_coverage(f).orderBy("category"))), ("Rules", grid(rules.rule_distribution(f).orderBy("category", F.desc("rows"), "text_rule_id"), 40)), ("Verdicts", grid(rules.verdict_quality(f).orderBy("category", "text_rule_verdict")))])


def oof_report(oof: DataFrame) -> str:
    by = metrics.evaluate(oof)
    mean = by.groupBy("model").agg(F.avg("f1").alias("mean_f1")).orderBy("model")
    return page("Out-of-fold models", [("F1", grid(by.orderBy("model", "category"))), ("Mean", grid(mean)), ("Disagreement", grid(metrics.disagreement(oof).orderBy("category")))])


def write(path: str, render: Callable[[], str]) -> None:
    from pathlib import Path

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(render())
