"""Charsets Spark's own ``decode`` does not know, Arrow batch by Arrow batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Charset reported by detection -> charset to decode with (superset, or a usual misdetection).
CHARSET_ALIASES = [("gb2312", "gbk"), ("windows-1252", "utf-8"), ("iso-8859-1", "utf-8")]
# Charsets tried in this order when detection is unsure, and the bound of "unsure".
FALLBACK_CHARSETS = ["utf-8", "gbk", "gb2312", "utf-16", "big5", "latin1"]
MIN_CONFIDENCE = 0.7


def _decode(data: bytes | None, charset: str | None, errors: str) -> str | None:
    if data is None or charset is None:
        return None
    try:
        return bytes(data).decode(charset, errors)
    except (UnicodeDecodeError, UnicodeError):
        return None


@F.pandas_udf(T.StringType())
def decode_strict(data: pd.Series, charset: pd.Series) -> pd.Series:
    """Decoded text, or NULL when a byte does not fit the charset."""
    return pd.Series([_decode(d, c, "strict") for d, c in zip(data, charset)], dtype=object)


@F.pandas_udf(T.StringType())
def decode_ignore(data: pd.Series, charset: pd.Series) -> pd.Series:
    """Decoded text with bytes that do not fit left out."""
    return pd.Series([_decode(d, c, "ignore") for d, c in zip(data, charset)], dtype=object)


def decode_bytes(data: Column, charset: Column, ignore_errors: bool = True) -> Column:
    """UTF-8 stays in the JVM; other charsets take the Arrow path (which then sees no UTF-8 bytes)."""
    is_utf8 = F.lower(charset).isin("utf-8", "utf8", "ascii")
    text = data.cast("string")
    other = F.when(is_utf8, F.lit(None)).otherwise(data)
    if ignore_errors:
        utf8 = F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit("")))
        return F.when(is_utf8, utf8).otherwise(decode_ignore(other, charset))
    return F.when(is_utf8, F.when(F.is_valid_utf8(text), text)).otherwise(decode_strict(other, charset))


@F.pandas_udf(T.BinaryType())
def encode_text(text: pd.Series, charset: pd.Series) -> pd.Series:
    """Text in a charset, for dumps written in one; characters outside it become ``?``."""
    return pd.Series(
        [None if t is None or c is None else t.encode(c, "replace") for t, c in zip(text, charset)], dtype=object
    )
