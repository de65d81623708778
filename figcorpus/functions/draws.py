"""Seeded draws that another engine computes as well."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*keys, seed: int = 0) -> Column:
    """48 bits of the md5 of the keys and the seed, written as text with bars between; null keys are left out."""
    written = F.concat_ws("|", *[(k if isinstance(k, Column) else F.col(k)).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(written), 1, 12), 16, 10).cast("bigint")


def draw_sql(*keys: str, seed: int = 0) -> str:
    """The same number in the SQL of the twins."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(f'({k})::VARCHAR' for k in keys)}, '{seed}')), 1, 12))::BIGINT"
