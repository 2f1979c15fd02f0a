"""Corpus order as numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written


def with_ordinals(docs: DataFrame, key: str) -> DataFrame:
    """Corpus order by a key column, numbered from 0: counts per range of the key first, so no task sees all rows.

    The ranges depend on a sample, so they are written before they are counted.
    """
    ranged = written(docs.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    offsets = sizes.select("_part", before.alias("_before"))
    return ranged.withColumn("_inside", inside).join(F.broadcast(offsets), "_part").withColumn("ordinal", (F.col("_before") + F.col("_inside")).cast("long")).drop("_part", "_inside", "_before")
