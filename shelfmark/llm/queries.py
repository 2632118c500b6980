"""The queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import exact_dedup, flac, language_id, near_dedup, packing, pieces, sharding, store, substring_dedup, token_counts, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    store.bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is on this machine; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_error_correcting_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs)
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(language_id.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "runner_up", "ambiguous")


def op2_flac_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = flac.from_flac(store.materialise(flac.to_flac(table(spark, sf_dir, "documents")), "flac"))
    return back.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op3_fast_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op4_bwt_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), whole_characters=True)
    return done.withColumn("text", F.col("kept").cast("string")).drop("kept")


def op5_order_preserving_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_shared_prefix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    back = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), path), path)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_xxhash64"), F.length("text").cast("long").alias("decoded_bytes"), F.sha2("text", 256).alias("decoded_sha256"))


def op8_offset_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.shard_rows(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_perfect_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    back = warc.read_archives(warc.write_archives(pages), with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_error_correcting_language_id, op2_flac_round_trip, op3_fast_sketch_near_dedup, op4_bwt_substring_dedup, op5_order_preserving_packing, op6_shared_prefix_pieces, op7_hypergeometric_shards, op8_offset_token_counts, op9_perfect_hash_dedup, op10_warc_round_trip)
}


def _base32(hex_column: str) -> str:
    """SQL for the base32 form of 40 hex digits: ten groups of four digits, then 5 bits at a time."""
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr({h}, {at}, 5))::BIGINT >> {shift}) & 31)::INT, 1)"
    parts = []
    for i in range(8):
        for j in range(4):
            parts.append(letter.format(h=hex_column, at=1 + 5 * i, shift=15 - 5 * j))
    return " || ".join(parts)


ORACLES: dict[str, str] = {
    "op3_fast_sketch_near_dedup": """
        WITH RECURSIVE w AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
        s AS MATERIALIZED (
            SELECT doc_id, unnest(list_distinct(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
                ELSE list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) END)) AS x FROM w),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        i AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL),
        e AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id)
        SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c.class_id) AS class_id, min(r.m) AS component_id, d.doc_id = min(r.m) AS kept
        FROM documents d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) JOIN (
            SELECT doc_id, CASE WHEN len(l) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY y, len(l) = 0) END AS class_id FROM (
                SELECT w.doc_id, l, list_sort(list(x)) AS y FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id, l)) c USING (doc_id)
        GROUP BY d.doc_id""",
    "op9_perfect_hash_dedup": """
        WITH k AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
        g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM k GROUP BY h)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k JOIN g USING (h)""",
    "op10_warc_round_trip": f"""
        WITH k AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
        g AS (SELECT h, min(page_id) AS first FROM k GROUP BY h)
        SELECT page_id, n::BIGINT AS payload_bytes, {_base32("h")} AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM k JOIN g USING (h)""",
}
