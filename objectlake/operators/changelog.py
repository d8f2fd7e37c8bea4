"""Change logs: order, durable prefix, last writer wins, merge with a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objectlake.schema import BATCH, CREATE_CLASS, DELETE, DROP_CLASS, KEYS, PUT


def flatten(log: DataFrame) -> DataFrame:
    """A row for each mutation: a batch's parts share its ``tx_id`` and are told apart by ``seq``."""
    own = F.array(F.struct(*[F.col(c) for c in ("op", "project", "class", "id", "data", "ts")]))
    parts = F.when(F.col("op") == BATCH, F.coalesce("sub", F.slice(own, 1, 0))).otherwise(own)
    return log.select("tx_id", F.posexplode(parts).alias("seq", "m")).select("tx_id", "seq", "m.*")


def durable_prefix(log: DataFrame, position: str, valid: Column, segment: str | None = None) -> DataFrame:
    """The rows before the first that is not valid, within each segment if one is named.

    One minimum for each segment and a filter: no global sort.
    """
    bad = F.when(~F.coalesce(valid, F.lit(False)), F.col(position))
    if segment is None:
        first = log.agg(F.min(bad).alias("_bad"))
        return log.join(F.broadcast(first), F.col("_bad").isNull() | (F.col(position) < F.col("_bad")), "inner").drop("_bad")
    first = log.groupBy(segment).agg(F.min(bad).alias("_bad"))
    return log.join(first, segment).where("_bad is null or " + f"`{position}` < _bad").drop("_bad")


def after(log: DataFrame, applied: int, tx: str = "tx_id") -> DataFrame:
    """What a watermark leaves to apply."""
    return log.where(F.col(tx) > applied)


def as_of(log: DataFrame, last: int, tx: str = "tx_id") -> DataFrame:
    return log.where(F.col(tx) <= last)


def net_delta(log: DataFrame, keys: list[str] = KEYS, order: tuple[str, ...] = ("tx_id", "seq"), deleted: Column | None = None, payload: tuple[str, ...] = ("data",)) -> DataFrame:
    """The last mutation of each key: keys, payload and ``deleted``.

    A maximum by the order, summed before the shuffle; payload and flag are one struct, so a null payload is no tombstone.
    """
    gone = F.col("op") == DELETE if deleted is None else deleted
    last = F.max_by(F.struct(*payload, gone.alias("deleted")), F.struct(*order))
    return log.groupBy(*keys).agg(last.alias("_last")).select(*keys, "_last.*")


def merge(snapshot: DataFrame, delta: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The snapshot with a net delta on top: later values win, tombstones remove."""
    columns = snapshot.columns
    return snapshot.join(delta.select(*keys), keys, "left_anti").select(*columns).unionByName(delta.where("not deleted").select(*columns))


def must_exist(requested: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the requested keys, those that rows have."""
    return requested.join(rows, keys, "left_semi")


def mutations(log: DataFrame) -> DataFrame:
    """Puts and deletes of objects alone."""
    return log.where(F.col("op").isin(PUT, DELETE))


def commit_groups(log: DataFrame, batch: int, tx: str = "tx_id") -> DataFrame:
    """How many records each full or last group commit has."""
    return log.groupBy(F.floor(F.col(tx) / batch).alias("batch")).agg(F.count("*").alias("n"))


def gapless(log: DataFrame, applied: int, tx: str = "tx_id") -> DataFrame:
    """One row, ``last``: the last transaction before the first one after ``applied`` that is missing."""
    ids = after(log, applied, tx).select(F.col(tx).alias("_tx")).distinct()
    reached = ids.unionByName(log.sparkSession.createDataFrame([(applied,)], "_tx long"))
    return reached.join(ids.select((F.col("_tx") - 1).alias("_tx")), "_tx", "left_anti").agg(F.min("_tx").alias("last"))


def catalog_delta(log: DataFrame) -> DataFrame:
    """What flattened mutations do to the catalog, a row for each (project, class) they touch.

    ``exists`` is null where no class is made or dropped, ``next_id`` where
    nothing is put after the last drop; ``dropped`` says that earlier ids count no more.
    """
    order = F.struct("tx_id", "seq")
    drop = F.max(F.when(F.col("op") == DROP_CLASS, order))
    last = F.max_by(F.col("op") == CREATE_CLASS, F.when(F.col("op").isin(CREATE_CLASS, DROP_CLASS), order))
    drops = log.groupBy("project", "class").agg(drop.alias("_drop"), last.alias("exists"))
    both = log.join(drops.select("project", "class", "_drop"), ["project", "class"])
    later = (F.col("op") == PUT) & (F.col("_drop").isNull() | (order > F.col("_drop")))
    ids = both.groupBy("project", "class").agg((F.max(F.when(later, F.col("id"))) + 1).alias("next_id"))
    return drops.join(ids, ["project", "class"]).select("project", "class", "exists", "next_id", F.col("_drop").isNotNull().alias("dropped"))
