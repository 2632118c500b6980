"""Logical checksums of tables."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from shelfmark.functions.text import stable_json


def ordered_checksum(df: DataFrame, key: str | Sequence[str] = "id") -> str:
    """SHA-256 over the rows as JSON lines in key order; rows stream through the driver one partition at a time."""
    digest = hashlib.sha256()
    for row in df.orderBy(*([key] if isinstance(key, str) else key)).toLocalIterator():
        digest.update(stable_json(list(row)).encode() + b"\n")
    return digest.hexdigest()


def multiset_checksum(df: DataFrame) -> DataFrame:
    """One row: rows, xor and sum of row hashes.  Does not depend on order; wholly distributed."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor_hash"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum_hash"))
