"""Stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next one's docs.  All but the last return the columns of documents:

1. language id: a document without any letter is rejected; the others get their predicted language as lang, or keep
   what they have where no document has a language to learn from.
2. exact dedup: of equal texts the row with the largest doc_id stays.
3. near dedup: of each component the row with the smallest doc_id stays; texts under one doc_id are told apart.
4. substring dedup: bytes of strings of PASSAGE_BYTES that repeat go; a document of which nothing but blanks is left goes
   with them.
5. packing: pieces of token sequences.

Defined cases: a null text is an empty one, and goes in stage 1; null lang, source or n_chars pass through (lang is set in
stage 1, n_chars anew where stage 4 cuts); of rows that repeat an id and a text stage 2 keeps one, the least by its other
columns, or none; a row with a null id goes only if stage 2 finds a copy of it, with an id or as one of null ids; an empty table passes as an empty one; columns beyond those of documents
are dropped at the start of a stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.llm import exact_dedup, language_id, near_dedup, packing, queries, store, substring_dedup

#: A passage of over 50 words has 51 at least, and these, with their blanks, about five bytes each or more.
PASSAGE_BYTES = 250
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _documents(docs)
    model = language_id.learn(docs)
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(docs, model)
    return _documents(found.filter(F.col("lang_pred") != language_id.UNKNOWN).withColumn("lang", F.col("lang_pred")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = exact_dedup.exact_dedup(docs).filter("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("rows"))
    kept = store.materialise(kept, "exact-kept")
    docs = _documents(docs).withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("d")
    same = F.col("d.text_sha256").eqNullSafe(F.col("k.text_sha256")) & F.col("d.doc_id").eqNullSafe(F.col("k.doc_id"))
    repeated = kept.filter("rows > 1")
    if repeated.isEmpty():
        return _documents(docs.join(kept.alias("k"), same, "left_semi"))
    once = _documents(docs.join(kept.filter("rows = 1").alias("k"), same, "left_semi"))
    more = docs.join(repeated.alias("k"), same, "left_semi").groupBy("doc_id", "text_sha256").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("least"))
    return once.unionByName(_documents(more.select("doc_id", "least.*")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _documents(docs)
    keyed, by_id = substring_dedup.with_rows(docs)
    if by_id:
        gone = near_dedup.near_dedup(docs).filter("not kept").select("doc_id").distinct()
        return _documents(docs.join(gone, "doc_id", "left_anti"))
    keyed = keyed.withColumn("_row", F.when(F.col("doc_id").isNotNull(), F.col("_row")))
    parts = near_dedup.near_dedup(keyed, "_row").filter("_row is not null").select("_row", "component_id").distinct()
    parts = store.materialise(parts.join(keyed.select("_row", "doc_id").distinct(), "_row"), "near-rows")
    first = parts.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("first")).select("component_id", F.col("first._row").alias("first"))
    gone = parts.join(first, "component_id").filter("_row <> first").select("_row")
    return _documents(keyed.join(gone, "_row", "left_anti"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed, _ = substring_dedup.with_rows(_documents(docs).withColumn("_null", F.col("text").isNull()))
    done = substring_dedup.removed(keyed, least=PASSAGE_BYTES, whole_characters=True)
    done = done.withColumns({"_cut": F.col("n_removed") > 0, "text": F.when(~F.col("_null"), F.col("kept").cast("string"))})
    left = done.withColumn("n_chars", F.when(F.col("_cut"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return _documents(left.filter(~F.col("_cut") | F.col("text").rlike(r"\S")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language id", identify_language),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("packing", pack_sequences),
]
#: Sketches, transforms and tokenizers are beyond SQL: tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = store.materialise(docs, "stage")
    return docs
