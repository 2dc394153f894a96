"""Hash-uniform numbers: all random choices of the library. They depend on seed and keys only, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_uniform(seed: str | int | Column, *keys: Column | str) -> Column:
    """A double in (0, 1) from the first 52 bits of an MD5 over seed and keys."""
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    digits = F.substring(F.md5(F.concat_ws("|", head, *(p.cast("string") for p in parts))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def sql_uniform(seed: str | int, *keys: str) -> str:
    """The same number as DuckDB SQL."""
    return f"((('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496)"
