"""Row numbers over a whole table without one task that sorts it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.sources.scratch import materialise


def numbered(df: DataFrame, keys: Sequence[tuple[Column, bool]], name: str = "number") -> DataFrame:
    """Add ``name``: 1, 2, ... in the order of ``keys``, (column, descending), which should tell all rows
    apart. Nulls come last.

    Rows go to ranges of the keys, are numbered within their range, and get the number of rows in the
    ranges before it: one count for each range comes to the driver."""
    placed = df.select("*", *[k.alias(f"_k{i}") for i, (k, _) in enumerate(keys)])
    order = [F.col(f"_k{i}").desc_nulls_last() if down else F.col(f"_k{i}").asc_nulls_last() for i, (_, down) in enumerate(keys)]
    ranged = materialise(placed.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    before, seen = [], 0
    for r, n in sorted(ranged.groupBy("_range").count().collect()):
        before.append((r, seen))
        seen += n
    offsets = df.sparkSession.createDataFrame(before, "_range int, _before long")
    row = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "_range").withColumn(name, (row + F.col("_before")).cast("long")).select(*df.columns, name)
