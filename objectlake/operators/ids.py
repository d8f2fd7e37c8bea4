"""Ids: the largest of each scope, and consecutive new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def max_ids(objects: DataFrame, scope: list[str], id_column: str = "id") -> DataFrame:
    return objects.groupBy(*scope).agg(F.max(id_column).alias("max_id"))


def assign(rows: DataFrame, scope: list[str], order: list[str], last: DataFrame | None = None, rows_in_task: int = 1_000_000) -> DataFrame:
    """Adds ``id``: consecutive from the scope's ``max_id`` + 1 in ``order``.

    A scope may hold most rows: its rows are cut into ranges of the first order
    column, numbered within, and moved on by the counts of the ranges before.
    """
    n = rows.count()
    parts = max(1, -(-n // rows_in_task))
    if parts == 1:
        ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*scope).orderBy(*order)).cast("long"))
    else:
        ordered = rows.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()).checkpoint()
        counts = ordered.groupBy(*scope, "_p").agg(F.count("*").alias("_c"))
        before = Window.partitionBy(*scope).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_b", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
        within = F.row_number().over(Window.partitionBy(*scope, "_p").orderBy(*order))
        ranked = ordered.withColumn("_w", within).join(counts, [*scope, "_p"]).withColumn("_n", (F.col("_w") + F.col("_b")).cast("long")).drop("_w", "_b", "_p")
    if last is None:
        return ranked.withColumnRenamed("_n", "id")
    return ranked.join(last, scope, "left").withColumn("id", F.coalesce("max_id", F.lit(0)) + F.col("_n")).drop("_n", "max_id")
