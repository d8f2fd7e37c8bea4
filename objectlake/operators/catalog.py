"""Catalog queries: projects, classes, guards, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def projects(catalog: DataFrame) -> DataFrame:
    return catalog.select("project").distinct().orderBy("project")


def classes(catalog: DataFrame, project: str) -> DataFrame:
    return catalog.where(F.col("project") == project).select("class").distinct().orderBy("class")


def droppable(catalog: DataFrame, objects: DataFrame, keys: list[str]) -> DataFrame:
    """Entries that no object refers to."""
    return catalog.join(objects, keys, "left_anti")


def stats(log: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: the last transaction, records and classes."""
    facts = log.agg(F.max("tx_id").alias("last_tx_id"), F.count("*").alias("log_records"))
    return facts.join(F.broadcast(catalog.select("project", "class").distinct().agg(F.count("*").alias("num_classes"))))
