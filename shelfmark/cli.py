"""python -m shelfmark.cli STAGE: one command for each stage, tables in and out as Parquet."""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence

from pyspark.sql import SparkSession

from shelfmark.contracts import FOLDS, GROUPS, IMAGE_HASHES, IMAGES
from shelfmark.operators import explain, folds, groups, images, manifest, models, rules, visual
from shelfmark.plans import reports
from shelfmark.session import session
from shelfmark.sources import tables


def _audit(spark: SparkSession, a: argparse.Namespace) -> None:
    df = tables.read_products(spark, a.data)
    reports.write(a.report, lambda: reports.audit_report(df))


def _groups(spark: SparkSession, a: argparse.Namespace) -> None:
    df = tables.read_products(spark, a.data)
    groups.validate_source(df)
    g = groups.text_groups(df)
    if a.pairs:
        g = groups.merge_visual(g, spark.read.parquet(a.pairs))
    tables.write_table(g, a.output, ("id",))
    g = tables.read_table(spark, a.output, GROUPS)
    groups.validate_groups(g, df)
    if a.conflicts:
        tables.write_table(groups.label_conflicts(g), a.conflicts)
    reports.write(a.report, lambda: reports.group_report(g))


def _folds(spark: SparkSession, a: argparse.Namespace) -> None:
    df, g = tables.read_products(spark, a.data), tables.read_table(spark, a.groups, GROUPS)
    folds.validate_inputs(df, g, a.splits)
    tables.write_table(folds.stratified_group_folds(g, a.splits, a.seed), a.output, ("id",))
    f = tables.read_table(spark, a.output, FOLDS)
    folds.validate_folds(f, g, a.splits)
    reports.write(a.report, lambda: reports.fold_report(f))


def _images(spark: SparkSession, a: argparse.Namespace) -> None:
    ids = tables.read_products(spark, a.data).select("id")
    images.validate_ids(ids)
    tables.write_table(images.scan_images(spark, a.images, ids), a.output, ("id", "image_index", "relative_path"))
    i = tables.read_table(spark, a.output, IMAGES)
    images.validate_images(i, ids)
    reports.write(a.report, lambda: reports.image_report(i, ids))


def _visual(spark: SparkSession, a: argparse.Namespace) -> None:
    i, ids, began = tables.read_table(spark, a.manifest, IMAGES), tables.read_products(spark, a.data).select("id"), time.time()
    hashes, reused = tables.reuse_or_build(spark, a.hashes, lambda: images.hash_images(spark, a.images, i), lambda h: visual.validate_hashes(h.select(*IMAGE_HASHES.names), i), a.reuse_hashes)
    hashed = time.time() - began
    tables.write_table(visual.visual_pairs(hashes), a.output, ("left_id", "right_id"))
    pairs = spark.read.parquet(a.output)
    visual.validate_pairs(pairs, ids)
    tables.write_stats(a.stats, hash_seconds=tables.read_stats(a.stats)["hash_seconds"] if reused else hashed, pair_seconds=time.time() - began - hashed, pairs=pairs.count(), kinds={r.match_kind: r["count"] for r in pairs.groupBy("match_kind").count().collect()})


def _manifest(spark: SparkSession, a: argparse.Namespace) -> None:
    df, g, f, i = tables.read_products(spark, a.data), tables.read_table(spark, a.groups, GROUPS), tables.read_table(spark, a.folds, FOLDS), tables.read_table(spark, a.images, IMAGES)
    manifest.validate_inputs(df, g, f)
    tables.write_table(manifest.product_manifest(df, g, f, i), a.output, ("id",))
    m = spark.read.parquet(a.output)
    manifest.validate_manifest(m, df, g, f, i)
    reports.write(a.report, lambda: reports.manifest_report(m))


def _rules(spark: SparkSession, a: argparse.Namespace) -> None:
    tables.write_table(rules.rule_features(tables.read_products(spark, a.data), tables.read_table(spark, a.folds, FOLDS)), a.output, ("id",))
    f = tables.read_table(spark, a.output, rules.FEATURES)
    rules.validate_features(f)
    reports.write(a.report, lambda: reports.rule_report(f))


def _models(spark: SparkSession, a: argparse.Namespace) -> None:
    df, f, r = tables.read_products(spark, a.data), tables.read_table(spark, a.folds, FOLDS), tables.read_table(spark, a.rules, rules.FEATURES)
    settings = models.Settings(max_iter=a.max_iter)
    tables.write_table(models.oof_table(df, f, r, settings), a.output, ("id",))
    oof = tables.read_table(spark, a.output, models.OOF)
    models.validate_oof(oof)
    if a.artifacts:
        models.save_models(models.final_models(models.texts_of(df, f), settings), a.artifacts, spark)
    reports.write(a.report, lambda: reports.oof_report(oof))


def _contract(spark: SparkSession, a: argparse.Namespace) -> None:
    rules.check_signals()
    reports.write(a.report, reports.contract_report)


def _explain(spark: SparkSession, a: argparse.Namespace) -> None:
    df = tables.read_products(spark, a.data)
    done = explain.explained(rules.decide(df))
    explain.validate_submission(done, df)
    tables.write_submission(done, a.output)


#: stage: (function, paths it needs, paths it may take, other options)
STAGES = {
    "audit": (_audit, ("data", "report"), (), {}),
    "groups": (_groups, ("data", "output", "report"), ("pairs", "conflicts"), {}),
    "folds": (_folds, ("data", "groups", "output", "report"), (), {"splits": 5, "seed": 42}),
    "images": (_images, ("data", "images", "output", "report"), (), {}),
    "visual": (_visual, ("data", "images", "manifest", "hashes", "output", "stats"), (), {"reuse_hashes": False}),
    "manifest": (_manifest, ("data", "groups", "folds", "images", "output", "report"), (), {}),
    "rules": (_rules, ("data", "folds", "output", "report"), (), {}),
    "models": (_models, ("data", "folds", "rules", "output", "report"), ("artifacts",), {"max_iter": 100}),
    "contract": (_contract, ("report",), (), {}),
    "explain": (_explain, ("data", "output"), (), {}),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="shelfmark", description=__doc__)
    commands = top.add_subparsers(dest="stage", required=True)
    for name, (_, needed, optional, options) in STAGES.items():
        own = commands.add_parser(name)
        for p in (*needed, *optional):
            own.add_argument(f"--{p}", required=p in needed)
        for option, default in options.items():
            flag = "--" + option.replace("_", "-")
            own.add_argument(flag, action="store_true") if default is False else own.add_argument(flag, type=type(default), default=default)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    STAGES[args.stage][0](spark or session(), args)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
