"""Text normal forms and stable identifiers."""

from __future__ import annotations

import html
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: U+241F between the parts of a signature.
SEPARATOR = "␟"


def normalized_text(column: Column | str) -> Column:
    """Lower case, runs of anything but letters and digits as one blank, trimmed; null is empty."""
    c = F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def blank(column: str) -> Column:
    """Not null, but nothing besides white space."""
    return F.col(column).isNotNull() & F.col(column).rlike(r"(?U)^\s*$")


def signature(*columns: Column | str, null: str = "") -> Column:
    """The columns' texts with SEPARATOR between them, null written as given."""
    parts: list[Column] = []
    for c in columns:
        parts += [F.lit(SEPARATOR), F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(null))]
    return F.concat(*parts[1:])


def stable_id(text: Column) -> Column:
    """g_ and 24 hex digits of the text's SHA-256."""
    return F.concat(F.lit("g_"), F.substring(F.sha2(text, 256), 1, 24))


def rule_text(value: str | None) -> str:
    """Entities resolved, NFKC, case folded, ё as е, white space collapsed."""
    folded = unicodedata.normalize("NFKC", html.unescape(value or "")).casefold()
    return " ".join(folded.replace("ё", "е").split())


_TAG = re.compile(r"<[^>]*>")


def plain_text(value: str | None) -> str:
    """rule_text of a text whose tags were taken out after resolving entities once."""
    return rule_text(_TAG.sub(" ", html.unescape(value or "")))


@F.pandas_udf(T.StringType())
def rule_text_of(values: pd.Series) -> pd.Series:
    return values.map(rule_text)


@F.pandas_udf(T.StringType())
def plain_text_of(values: pd.Series) -> pd.Series:
    return values.map(plain_text)


def composed(name: Column | str, description: Column | str) -> Column:
    """One text of both fields for the models, each after its mark."""
    return F.trim(F.concat(F.lit("__name__ "), plain_text_of(name), F.lit(" __description__ "), plain_text_of(description)))


def stable_json(value: object) -> str:
    """Compact JSON with sorted keys, other alphabets as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
