"""Applies a change log that arrives as files to generations of objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from objectlake.operators import changelog
from objectlake.schema import LOG
from objectlake.sources.generations import Generations


def apply_batch(generations: Generations, log: DataFrame) -> int:
    """Folds a part of the log into the next generation, objects, classes and next ids.

    Transactions are applied in order and without gaps: what comes after one
    that is missing waits, written beside the generation, until that one is
    there.  What was applied before is skipped, so a batch may come again.
    """
    spark, manifest = log.sparkSession, generations.manifest()
    applied, waiting = manifest["applied"], manifest.get("waiting")
    fresh = changelog.after(log, applied)
    if fresh.isEmpty():
        return generations.current()
    if waiting:
        fresh = fresh.unionByName(spark.read.schema(LOG).parquet(f"{generations.files.root}/{waiting}"))
    fresh = changelog.after(fresh, applied).dropDuplicates(["tx_id"])
    last = changelog.gapless(fresh, applied).first()["last"]
    late, now = changelog.after(fresh, last), changelog.flatten(changelog.as_of(fresh, last))
    facts = {"classes": {tuple(c) for c in manifest.get("classes", [])}, "next_ids": {(p, c): n for p, c, n in manifest.get("next_ids", [])}}
    for row in changelog.catalog_delta(now).collect():  # a row for each class
        scope = (row["project"], row["class"])
        if row["exists"] is not None:
            (facts["classes"].add if row["exists"] else facts["classes"].discard)(scope)
        before = 1 if row["dropped"] else facts["next_ids"].get(scope, 1)
        facts["next_ids"][scope] = max(before, row["next_id"] or 1)
    more = {"classes": sorted(facts["classes"]), "next_ids": [[*s, n] for s, n in sorted(facts["next_ids"].items())]}
    if not late.isEmpty():
        more["waiting"] = f"waiting-{generations.current() + 1}"
        late.select(*LOG.names).write.mode("overwrite").parquet(f"{generations.files.root}/{more['waiting']}")
    delta = changelog.net_delta(changelog.mutations(now)).withColumnRenamed("data", "doc")
    n = generations.publish(changelog.merge(generations.read(), delta), last, **more)
    if waiting:
        generations.files.delete(waiting)
    return n


def apply_stream(spark: SparkSession, log_path: str, root: str, checkpoint: str, files_a_batch: int = 256, seconds: float | None = None) -> StreamingQuery:
    """Reads Parquet log segments as they appear, in the order of their arrival.

    Each micro-batch is one group commit.  Without ``seconds`` it applies what is there and stops.
    """
    generations = Generations(spark, root)
    log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_a_batch).parquet(log_path)
    writer = log.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: apply_batch(generations, batch) and None)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()
