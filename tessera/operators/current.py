"""Current rows of a table whose keys may be delivered more than once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_rows(df: DataFrame, key: str, columns: Sequence[str | Column] = (), arrived: str = "ingested_at") -> DataFrame:
    """The row with the latest ``arrived`` of each ``key``; only ``key`` and ``columns`` are read.

    One aggregation with map-side combine, so a key that holds a third of all
    rows costs each mapper one row of it.  Rows of equal time are identical by
    contract; were they not, the largest by column order would be kept.  A null
    time counts as earliest.  Rows with a null key have nothing to compete
    with: they stay, identical ones once.
    """
    payload = [c if isinstance(c, Column) else F.col(f"`{c}`") for c in columns]
    inner = df.select(F.col(f"`{key}`").alias("_key"), F.struct(F.col(f"`{arrived}`").alias("_at"), *payload).alias("_row"))
    inner = inner.withColumn("_alone", F.when(F.col("_key").isNull(), F.xxhash64("_row")))
    newest = inner.groupBy("_key", "_alone").agg(F.max("_row").alias("_row"))
    names = [f.name for f in newest.schema["_row"].dataType.fields if f.name != "_at"]
    return newest.select(F.col("_key").alias(key), *(F.col(f"_row.`{n}`").alias(n) for n in names))
