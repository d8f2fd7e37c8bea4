"""What the operators share: input tables, scratch tables, Arrow helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers that don't share the driver's path.

    Where the session leaves the rows of an Arrow batch to Spark, it gets fewer, from then on: rows are whole texts
    here, and Spark reads that setting as a query runs.
    Workers of local sessions have the driver's PYTHONPATH and working folder; others are sent a copy, once.
    """
    if spark.conf.get(BATCH_ROWS, None) is None:
        spark.conf.set(BATCH_ROWS, "2000")
    known = [os.path.realpath(p or ".") for p in [*os.environ.get("PYTHONPATH", "").split(":"), os.getcwd()]]
    context = spark.sparkContext
    if context.master.startswith("local") and os.path.realpath(ROOT) in known or getattr(context, "_objectlake_shipped", False):
        return
    top = tempfile.mkdtemp(prefix="objectlake-ship-")
    atexit.register(shutil.rmtree, top, True)
    context.addPyFile(shutil.make_archive(f"{top}/objectlake", "zip", ROOT, "objectlake"))
    context._objectlake_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a table that is read in fewer tasks than there are cores to as many tasks as cores; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def scratch(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir; a temporary folder only for local sessions that set none."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="objectlake-")
        spark.sparkContext._conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
        atexit.register(shutil.rmtree, base, True)
    return f"{base.rstrip('/')}/objectlake-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, *facts: Column) -> DataFrame:
    """Writes ``df`` to the shared scratch folder and reads it back, which cuts the lineage.

    ``facts`` are aggregates of its rows, with names, that are taken as it is
    written; the result has them in ``facts``.
    """
    spark = df.sparkSession
    path, seen = scratch(spark), Observation()
    (df.observe(seen, *facts) if facts else df).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.path, out.facts = path, seen.get if facts else {}
    _made(spark, path)
    return out


#: Paths and table names that are deleted at the end of the process, or of ``temporary``.
_MADE: list[tuple[SparkSession, str, str | None]] = []


def _made(spark: SparkSession, path: str, name: str | None = None) -> None:
    if not _MADE:
        atexit.register(_clear, 0)
    _MADE.append((spark, path, name))


def _clear(since: int, kept: frozenset[str] = frozenset()) -> None:
    stay = [made for made in _MADE[since:] if made[1] in kept]
    for spark, path, name in _MADE[since:]:
        if path not in kept and spark.sparkContext._jsc is not None:
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(spark, path)
    _MADE[since:] = stay


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame], None]]:
    """Deletes at its end what ``written`` and ``bucketed`` have made within it, but for tables that are passed to what it yields."""
    since, keep = len(_MADE), []
    try:
        yield keep.append
    finally:
        _clear(since, frozenset(df.path for df in keep))


def partitions(spark: SparkSession, size: int = 0, each: int = 32 << 20) -> int:
    """Partitions of a shuffle: what the session sets, no fewer than there are cores, and more where ``size`` bytes would exceed ``each``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-size // each))


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Shuffles ``df`` by ``key`` and writes it as a bucketed table in the scratch folder: joins on ``key`` then read it as it is."""
    spark = df.sparkSession
    path, name, parts = scratch(spark), f"objectlake_{uuid.uuid4().hex}", min(partitions(spark), 100_000)
    df.repartition(parts, key).write.bucketBy(parts, key).option("path", path).option("compression", "uncompressed").format("parquet").saveAsTable(name)
    _made(spark, path, name)
    return spark.table(name)


#: A key with more than one row in so many is joined apart, so there are fewer such keys than this.
SHARE = 1000


def join_counted(rows: DataFrame, one: DataFrame, key: str | list[str], total: int, how: str = "inner", spread: str | None = None) -> DataFrame:
    """Joins ``rows`` with ``one``, which has a row for each ``key`` and, as ``_n``, how many of the ``total`` rows have that key.

    Keys that have more than a share of the rows, of which there are fewer than
    ``SHARE``, are dealt to several tasks each, by ``spread`` (a column of ``rows``);
    of few rows no key has many.
    """
    keys = [key] if isinstance(key, str) else key
    if total <= 10 * SHARE:
        return rows.join(one.drop("_n"), keys, how)
    most = total // SHARE
    hot = one.where(F.col("_n") > most).select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_deals"))
    deal = F.pmod(F.xxhash64(F.lit(5), F.col(spread or rows.columns[0])), F.col("_deals")).cast("int")
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_deal", F.coalesce(deal, F.lit(0))).drop("_deals")
    copies = F.greatest(F.lit(1), F.when(F.col("_n") > most, F.ceil(F.col("_n") / most))).cast("int")
    each = one.withColumn("_deal", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_n")
    return dealt.join(each, [*keys, "_deal"], how).drop("_deal")


#: Bits of the map that ``likely`` sends to all tasks, 8 MB in all, in rows of Spark's bitmaps.
BITS, BITMAP = 1 << 26, 32_768


def _marked(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Adds ``_likely``: true for all rows whose ``key`` is in ``ids``, and for few others.

    What is sent to all tasks has the same size however many ids there are; a full map marks all rows.
    """
    bit = F.pmod(F.xxhash64(F.lit(11), F.col(key)), F.lit(BITS))
    at = F.bitmap_bit_position(bit % BITMAP + 1)
    map_ = (bit / BITMAP).cast("int").alias("_map")
    maps = ids.select(map_, at.alias("_bit")).groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    met = rows.select("*", map_, at.alias("_at")).join(F.broadcast(maps), "_map", "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    test = F.call_function("shiftright", byte, (F.col("_at") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return met.select(*rows.columns, F.coalesce(test, F.lit(False)).alias("_likely"))


def likely(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Of ``rows`` all whose ``key`` is in ``ids``, and few others, before a join that shuffles them."""
    return _marked(rows, ids, key).where("_likely").drop("_likely")


def without(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` whose ``key`` is not in ``ids``; only those that may be are shuffled.  ``rows`` are read twice."""
    marked = _marked(rows, ids, key)
    return marked.where("not _likely").drop("_likely").unionByName(marked.where("_likely").drop("_likely").join(ids.select(key), key, "left_anti").select(*rows.columns))


def texts(column: pa.Array) -> list[str]:
    """The strings of a column; null is the empty string."""
    return [x or "" for x in column.to_pylist()]


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def refuse(columns: list[str], taken: tuple[str, ...]) -> None:
    """Columns of the caller that have the name of a result are an error, before anything runs."""
    if clash := sorted(set(columns) & set(taken)):
        raise ValueError(f"rename the columns {', '.join(clash)}")


def worker_memory() -> None:
    """Keeps native thread pools of a Python worker to one thread: Spark runs a worker per core."""
    for name in ("OMP_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))
