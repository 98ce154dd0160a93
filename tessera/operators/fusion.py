"""Fusing ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reciprocal_rank_fusion(a: DataFrame, b: DataFrame, key: str, k: int = 60, both_bonus: float = 0.005) -> DataFrame:
    """Full outer fusion of two lists (key, rank): key, a_rank, b_rank, mode, fusion."""
    x, y = a.select(key, F.col("rank").alias("a_rank")), b.select(key, F.col("rank").alias("b_rank"))
    part = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c)), F.lit(0.0))
    both = F.col("a_rank").isNotNull() & F.col("b_rank").isNotNull()
    mode = F.when(both, "hybrid").when(F.col("a_rank").isNull(), "vector_only").otherwise("lexical_only")
    return x.join(y, key, "full_outer").select(key, "a_rank", "b_rank", mode.alias("mode"), F.round(part("a_rank") + part("b_rank") + F.when(both, both_bonus).otherwise(0.0), 6).alias("fusion"))
