"""Readers and writers of tables, statistics, training sets and caches."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shelfmark.contracts import PRODUCTS, check_schema, require_columns


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of products: typed by contract where a name is known, other columns kept; an unnamed index column is _c0.

    An empty field without quotes is null, an empty quoted one is an empty text.
    """
    options = {"header": True, "multiLine": True, "escape": '"', "nullValue": "\u0000"}
    df = spark.read.options(**options).csv(path)
    types = {f.name: f.dataType for f in PRODUCTS}
    own = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c)) if types[c] == T.LongType() else F.col(c)
    df = df.select(*[own(c).cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns])
    return df.withColumn("_c0", F.col("_c0").cast("long")) if "_c0" in df.columns else df


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table; with a schema, it must be exactly that."""
    df = spark.read.parquet(path)
    return check_schema(df, schema, path) if schema is not None else df


def write_table(df: DataFrame, path: str, sort: tuple[str, ...] = (), partition_by: tuple[str, ...] = ()) -> None:
    """zstd Parquet; sorted within files, dealt by range of the sort columns, if any are given, nulls last."""
    if sort:
        order = [F.asc_nulls_last(c) for c in sort]
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def discover_files(root: str) -> tuple[list[str], list[str]]:
    """(files, ignored) under a local folder as sorted relative paths; hidden ones and archive metadata are ignored."""
    if not os.path.isdir(root):
        raise NotADirectoryError(root) if os.path.exists(root) else FileNotFoundError(root)
    found = sorted(Path(d, n).relative_to(root).as_posix() for d, _, names in os.walk(root) for n in names)
    hidden = lambda p: any(x.startswith(".") or x in ("__MACOSX", "Thumbs.db") for x in p.split("/"))
    return [p for p in found if not hidden(p)], [p for p in found if hidden(p)]


def write_stats(path: str, **values: object) -> None:
    """Statistics of a run as JSON on the driver."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(values, ensure_ascii=False, indent=2, sort_keys=True) + "\n")


def read_stats(path: str, keys: tuple[str, ...] = ()) -> dict:
    values = json.loads(Path(path).read_text())
    if missing := sorted(set(keys) - set(values)):
        raise ValueError(f"{path}: missing {', '.join(missing)}")
    return values


def read_config(path: str, required: dict[str, type], optional: dict[str, type] | None = None) -> dict:
    """A YAML mapping of version 1 with exactly these keys and types; dotted keys name nested ones."""

    def flat(value: object, prefix: str = "") -> dict:
        if isinstance(value, dict) and not (prefix and {**required, **(optional or {})}.get(prefix) is dict):
            return {k: v for key, inner in value.items() for k, v in flat(inner, f"{prefix}.{key}" if prefix else str(key)).items()}
        return {prefix: value}

    values = yaml.safe_load(Path(path).read_text())
    if not isinstance(values, dict):
        raise ValueError(f"{path}: not a mapping")
    values, allowed = flat(values), required | (optional or {})
    problems = [f"missing {k}" for k in sorted(set(required) - set(values))] + [f"unknown {k}" for k in sorted(set(values) - set(allowed))]
    problems += [f"{k} is not {allowed[k].__name__}" for k, v in values.items() if k in allowed and (not isinstance(v, allowed[k]) or (allowed[k] is int and isinstance(v, bool)))]
    if values.get("version", 1) != 1:
        problems.append("version is not 1")
    if problems:
        raise ValueError(f"{path}: " + "; ".join(problems))
    return values


def reuse_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], check: Callable[[DataFrame], None], reuse: bool = True) -> tuple[DataFrame, bool]:
    """(table, whether it was there): a stored table is checked again before use; else it is built, checked and stored."""
    store = spark._jvm.org.apache.hadoop.fs.Path(path)
    if reuse and store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(store):
        df = spark.read.parquet(path)
        check(df)
        return df, True
    write_table(build(), path)
    df = spark.read.parquet(path)
    check(df)
    return df, False


def append_missing(spark: SparkSession, inputs: DataFrame, path: str, schema: T.StructType, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A cache that resumes: only inputs whose key is not stored yet are computed and appended."""
    store = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(store)
    todo = inputs.join(spark.read.schema(schema).parquet(path).select(key), key, "left_anti") if there else inputs
    compute(todo).select(*schema.names).write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Lines that are not of the schema raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_submission(df: DataFrame, path: str) -> None:
    """CSV parts of id, result; in the order of their names they hold the rows in id order, and each has a header."""
    require_columns(df, ("id", "result"), "submission")
    df.select("id", "result").orderBy("id").write.mode("overwrite").options(header=True, quoteAll=False, escape='"').csv(path)


OCR_TEXT = T.StructType([T.StructField("id", T.LongType()), T.StructField("source_image_id", T.LongType()), T.StructField("ocr_text", T.StringType()), T.StructField("ocr_quality", T.DoubleType())])
EMBEDDINGS = T.StructType([T.StructField("id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType()))])
