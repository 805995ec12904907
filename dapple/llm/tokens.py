"""Tokens: the matches of ``\\w+|[^\\w\\s]+`` with Unicode classes, counted in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE}]+"


def token_count(text: Column) -> Column:
    """Tokens of a text as bigint; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)).cast("bigint"), F.lit(0).cast("bigint"))
