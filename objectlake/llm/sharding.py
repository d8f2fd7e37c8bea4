"""Proportional stratified interleaving of rows into shards.

Rows are shuffled by a seeded hash within their source; the k-th of n rows of
a source has the fractional rank (k + 1/2) / n; in the order of fractional
ranks every stretch of rows has the sources in the proportions of the whole,
and the order is cut into shards whose row counts are at most one apart.

Both ranks come from range-partitioned sorts, in which a source of any size
spreads over many partitions, plus the counts of the partitions before.  A
null source is a source of its own; rows that are the same, or repeat an id, are
ranked one after the other; an empty table gives an empty result.  Texts are not
looked at, so those of any length will do.  Of equal texts nothing is asked:
counts of rows are equal whatever they hold.  Columns named ``shard`` or
``slot`` are refused, as are names that begin with an underscore.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from objectlake.llm.common import refuse, written

#: Rows in a partition of the sorts, on average.
SORT_ROWS = 200_000


def positioned(df: DataFrame, n_rows: int, order: list, name: str) -> DataFrame:
    """Adds ``name``: the place of each row, from 0, in the order of the columns ``order``.

    The sorted rows are written out, so that places stay the same if a task
    runs again.  Only a count for each partition is gathered.
    """
    spread = df.repartitionByRange(max(1, -(-n_rows // SORT_ROWS)), *order)
    row = F.monotonically_increasing_id()  # partition number << 33 | row within it
    stored = written(spread.sortWithinPartitions(*order).withColumn("_row", row))
    part = F.shiftright("_row", 33)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = stored.withColumn("_part", part).join(starts, "_part")
    return out.withColumn(name, F.col("_start") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_row", "_start")


def interleave(df: DataFrame, shards: int, source: str = "source", key: str = "doc_id", seed: int = 0) -> DataFrame:
    """Adds ``shard`` (0 to ``shards`` - 1) and ``slot`` (from 0, gapless in each shard) to the rows of ``df``.

    ``df`` should be narrow: its rows are sorted twice.
    """
    refuse(df.columns, ("shard", "slot", *(c for c in df.columns if c.startswith("_"))))
    n = df.count()
    shuffled = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")))
    first = positioned(shuffled, n, [source, "_h", key], "_at")
    strata = first.groupBy(source).agg(F.min("_at").alias("_low"), F.count("*").alias("_of"))
    same = first[source].eqNullSafe(strata[source])
    ranked = first.join(strata, same).drop(strata[source])
    ranked = ranked.withColumn("_f", (F.col("_at") - F.col("_low") + F.lit(0.5)) / F.col("_of")).drop("_at", "_low", "_of")
    placed = positioned(ranked, n, ["_f", source, "_h", key], "_at")
    shard = F.expr(f"(_at * {shards}L) div {max(n, 1)}L")
    start = F.expr(f"(_shard * {max(n, 1)}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("_shard", shard).withColumn("slot", F.col("_at") - start).withColumn("shard", F.col("_shard").cast("int")).drop("_shard", "_at", "_f", "_h")
