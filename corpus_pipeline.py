"""From raw documents to packed training sequences, one operator a stage.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir),
works on all rows of ``docs`` and returns a DataFrame, which ``run`` writes as
Parquet and reads again for the next stage.  All but the last return the
columns of ``documents``.  Rows may repeat an id or have none; columns other
than those of ``documents`` are left out; null texts go with the first stage;
empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from objectlake.llm import langid, minhash, packing, repeats, secrets
from objectlake.llm.common import remove, scratch, ship, table, temporary, without, written

#: A document goes if its language can't be told, or only with less than this score.
LANGUAGE_SCORE = 0.3

#: Documents are near copies if their sets of five-word shingles are this similar, in percent.
SIMILAR = 80

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; ``lang`` becomes the recognised one where it is null."""
    ship(spark)
    model = langid.learn(docs.select("doc_id", "text", "lang"))
    told = langid.identify(docs.select(*COLUMNS), model)
    keep = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE)
    return told.where(keep).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: one with the smallest id, or any where none has an id.  Rows without words are in no group and stay."""
    ship(spark)
    rows = written(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()))  # rows that repeat one id, or have none, are told apart
    with temporary() as keep:
        near = minhash.near_duplicates(rows, key="_row", num=SIMILAR).select(F.col("doc_id").alias("_row"), "component_id")
        near = written(near.join(rows.select("_row", "doc_id"), "_row"))
        keep(near)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first")
    stay = near.groupBy("component_id").agg(first).select("first._row")
    return without(rows, near.select("_row").join(stay, "_row", "left_anti"), "_row").select(*COLUMNS)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts; a character that is cut through goes as a whole.  Documents stay, if with less text; null text becomes empty."""
    ship(spark)
    out = repeats.removed(docs, as_text=True, carry=("doc_id", "lang", "source")).select("carried.*", F.col("kept").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces what the scan reports by a mark."""
    ship(spark)
    found = secrets.scan(docs, carry=COLUMNS[1:])
    return found.withColumn("text", secrets.redacted(F.col("text"), F.col("spans"))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents into sequences: a row for each piece of a document and its place."""
    ship(spark)
    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    small = written(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packing.pack(small, ["doc_id", "piece", "ids_crc32"])


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("repeat_removal", repeat_removal),
    ("secret_removal", secret_removal),
    ("packing", sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each one's result is written to the shared scratch folder, where the last one's stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = scratch(spark)
        with temporary():
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
