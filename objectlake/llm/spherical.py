"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

Vectors are rotated and cut into blocks; each block has a few random unit code
words, and a filter is one word for each block.  A vector passes the filters
whose direction it agrees with beyond a threshold; they are list-decoded from
sorted sums over the two blocks, not by trying all filters.  Vectors that
pass a filter together are compared, in double precision, and a pair counts
with the smallest filter it shares, so none counts twice.  Large buckets are
compared block by block, each pair of blocks in a task of its own; tasks return
a count and one link for each vector, never pairs.

The number of filters follows the number of vectors, so that few others pass a
filter by chance; the threshold is set on simulated pairs that agree exactly as
much as asked for, of which ``RECALL`` must share a filter.  Pairs that agree
more are found more surely, equal vectors always.

The code's rotations and words are drawn again from their seed by each worker,
so what is sent with a task doesn't grow; their size follows the root of the
number of vectors.

Equal vectors are one class with a count.  Null vectors, zero vectors and those
with null or non-finite parts link with nothing; neither do vectors of
different lengths.  Ids are integers; rows without one are in no group; rows
that repeat one are vectors of their own.  Only the id and the vector are read,
so other columns' names can't clash.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objectlake.llm.common import join_counted, partitions, written
from objectlake.llm.components import components
from objectlake.llm.minhash import Forest, grouped

#: Share of simulated pairs, right at the threshold, that must meet in a filter.
RECALL = 0.98

#: Independent product codes of two blocks.
CODES = 16

#: Filters that a vector passes at least.
FEWEST = 8

#: Filters that a vector passes, about, and vectors that pass a filter by chance, on average.
LISTED, BY_CHANCE = 16.0, 12.0

#: Members of a bucket that are compared at once.
BLOCK = 2048

PAIRS, SEED = 600, 77


@dataclass(frozen=True)
class Code:
    """The filters for vectors of one length: several product codes, each with a rotation and the words of its blocks, drawn from the seed."""

    width: int
    words: int
    seed: int
    least: float = 0.0

    @property
    def parts(self) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        return _drawn(self.width, self.words, self.seed)

    def sums(self, part: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector how much it agrees with the words of the first and of the second block."""
        rotation, words = self.parts[part]
        y, cut = x @ rotation, words[0].shape[1]
        return y[:, :cut] @ words[0].T, (y[:, cut:] @ words[1].T if len(words) > 1 else np.zeros((len(x), 1)))

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """The numbers of the filters that each unit vector passes, ascending.

        Vectors that pass few have a lower threshold, so that none goes unfiltered.
        """
        out, least = self.beyond(x, self.least), self.least
        while few := [i for i, f in enumerate(out) if len(f) < FEWEST]:
            least -= 0.25
            for i, f in zip(few, self.beyond(x[few], least), strict=True):
                out[i] = f
            if least < -8:
                break
        return out

    def beyond(self, x: np.ndarray, least: float) -> list[np.ndarray]:
        """The numbers of all filters with which each unit vector agrees by ``least``, ascending.

        Words of the second block are sorted, so that each word of the first
        has its filters in a stretch, found by bisection.
        """
        out: list[list[np.ndarray]] = [[] for _ in x]
        base = 0
        for part in range(len(self.parts)):
            left, right = self.sums(part, x)
            order = np.argsort(-right, axis=1)
            most = np.take_along_axis(right, order[:, :1], 1)
            for v, rows in enumerate(left >= least - most):
                rows = np.flatnonzero(rows)
                if not len(rows):
                    continue
                n = np.searchsorted(-right[v, order[v]], left[v, rows] - least, side="right")
                first = np.repeat(np.cumsum(n) - n, n)
                out[v].append(np.sort(np.repeat(rows, n) * right.shape[1] + order[v, np.arange(n.sum()) - first]) + base)
            base += left.shape[1] * right.shape[1]
        return [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]


def unit(rng: np.random.Generator, n: int, width: int) -> np.ndarray:
    x = rng.standard_normal((n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@lru_cache(maxsize=4)
def _drawn(width: int, words: int, seed: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    rng = np.random.default_rng([seed, width])
    sizes = [width - width // 2, width // 2] if width > 1 else [1]
    return [(np.linalg.qr(rng.standard_normal((width, width)))[0], [unit(rng, words, s) * np.sqrt(s) for s in sizes]) for _ in range(CODES)]


def make_code(width: int, n: int, cosine: float, recall: float = RECALL, seed: int = SEED) -> Code:
    """A code for ``n`` vectors of ``width`` parts; the same for the same arguments."""
    rng = np.random.default_rng([seed, width, 1])
    filters = max(64.0, n * LISTED / BY_CHANCE / CODES)
    code = Code(width, int(np.ceil(filters**0.5)) if width > 1 else 2, seed)
    a = unit(rng, PAIRS, width)
    b = unit(rng, PAIRS, width)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    if width > 1:
        b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = cosine * a + np.sqrt(max(0.0, 1 - cosine * cosine)) * b
    # the largest threshold, to a few hundredths, with which the pairs meet as often as they must
    low, high = 0.0, 6.0
    while high - low > 0.03:
        least = (low + high) / 2
        meet = sum(bool(np.intersect1d(p, q, assume_unique=True).size) for p, q in zip(code.beyond(a, least), code.beyond(b, least), strict=True))
        low, high = (least, high) if meet >= recall * PAIRS else (low, least)
    return replace(code, least=low)


def classes(df: DataFrame, vector: str, key: str) -> DataFrame:
    """(id, n, hi, lo, vec) for each row: the number of parts (0: links with nothing), a digest and the doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hi, lo, vec = [], [], [], []
            for x in batch.column(1).to_pylist():
                v = np.array([np.nan if p is None else p for p in x or []], np.float64)
                ok = len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any())
                v = v + 0.0  # one zero
                d = xxhash.xxh3_128_digest(v.tobytes())
                n.append(len(v) if ok else 0)
                hi.append(int.from_bytes(d[:8], "little", signed=True))
                lo.append(int.from_bytes(d[8:], "little", signed=True))
                vec.append(packed(v) if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(vec, pa.binary())], names=["id", "n", "hi", "lo", "vec"])

    return df.select(F.col(key).cast("long").alias("id"), F.col(vector)).mapInArrow(run, "id long, n int, hi long, lo long, vec binary")


def packed(v: np.ndarray) -> bytes:
    """The doubles, in half the bytes where that loses nothing."""
    with np.errstate(over="ignore"):
        short = v.astype(np.float32)
    return b"f" + short.tobytes() if np.array_equal(short.astype(np.float64), v) else b"d" + v.tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, b[:1].decode(), offset=1).astype(np.float64)


def decoded(reps: DataFrame, codes: dict[int, Code]) -> DataFrame:
    """Adds ``filters``, all that a vector passes; the number of parts is in the high bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                rows = [unpacked(v) for v in part.column(2).to_pylist()]
                found: list = [None] * len(rows)
                for width in {len(r) for r in rows}:
                    at = [i for i, r in enumerate(rows) if len(r) == width]
                    x = np.stack([scaled(rows[i]) for i in at])
                    for i, f in zip(at, codes[width].decode(x), strict=True):
                        found[i] = f + (width << 44)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.int64()))], names=["id", "copies", "vec", "filters"])

    return reps.select("id", "copies", "vec").mapInArrow(run, "id long, copies long, vec binary, filters array<long>")


def scaled(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()  # squares neither overflow nor vanish
    return v / np.sqrt(v @ v)


def compare(f: int, across: bool, rows: list[tuple], cosine: float) -> tuple[list[int], list[int], list[int]]:
    """For each member of a bucket with new links: its id, how many vectors they lead to, and the smallest member of its tree."""
    n = len(rows)
    x = np.stack([scaled(unpacked(r[3])) for r in rows])
    side = np.array([r[0] for r in rows])
    copies = np.array([r[2] for r in rows], np.int64)
    dot = x @ x.T
    a, b = np.nonzero(np.triu(dot >= cosine - 1e-9, 1))
    if across:
        other = side[a] != side[b]
        a, b = a[other], b[other]
    close = np.abs(dot[a, b] - cosine) < 1e-9
    if close.any():  # decided by sums in one order, whatever the bucket
        exact = np.array([float((x[i] * x[j]).sum()) for i, j in zip(a[close], b[close], strict=True)])
        keep = np.ones(len(a), bool)
        keep[close] = exact >= cosine
        a, b = a[keep], b[keep]
    if len(a):  # pairs that share a smaller filter count there
        has: dict[int, list[int]] = {}
        for i in np.unique(np.concatenate([a, b])).tolist():
            for g in rows[i][4]:
                if g < f:
                    has.setdefault(g, []).append(i)
        old = np.zeros((n, n), bool)
        for members in has.values():
            if len(members) > 1:
                old[np.ix_(members, members)] = True
        fresh = ~old[a, b]
        a, b = a[fresh], b[fresh]
    if not len(a):
        return [], [], []
    links = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
    forest = Forest(n)
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        forest.join(i, j)
    who = np.flatnonzero(links).tolist()
    return [rows[i][1] for i in who], [int(links[i]) for i in who], [rows[forest.find(i)][1] for i in who]


def near_duplicates(df: DataFrame, vector: str = "embedding", key: str = "vec_id", cosine: float = 0.9, recall: float = RECALL) -> DataFrame:
    """The key (as ``vec_id``), ``n_links``, ``component_id`` and ``kept`` of every row."""
    spark = df.sparkSession
    every, valid = classes(df, vector, key), (F.col("n") > 0) & F.col("id").isNotNull()
    narrow = written(every.select("id", "n", "hi", "lo"))
    some = narrow.where(valid)
    reps = every.where(valid).groupBy("hi", "lo").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("vec").alias("vec"))
    counts = some.groupBy("n").count().collect()  # a row for each length of vectors
    codes = {r.n: make_code(r.n, r["count"], cosine, recall) for r in counts}
    found = written(decoded(reps, codes), F.sum(F.octet_length("vec") + 8 * F.size("filters")).alias("bytes"))
    rows = found.withColumn("f", F.explode("filters"))
    sizes = rows.groupBy("f").count().where(F.col("count") > BLOCK).withColumn("_blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    dealt = rows.join(sizes, "f", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.select("f", F.least("side", "_o").alias("x"), F.greatest("side", "_o").alias("y"), "side", "id", "copies", "vec", "filters")
    parts = max(4 * spark.sparkContext.defaultParallelism, partitions(spark, int(LISTED) * (found.facts["bytes"] or 0)))
    dealt = dealt.repartition(parts, "f", "x", "y").sortWithinPartitions("f", "x", "y", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])
        for (f, x, y), group in grouped(batches, 3):
            if len(group) > 1:
                for column, more in zip(out, compare(f, x != y, group, cosine), strict=True):
                    column += more
            if len(out[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["id", "links", "root"])
                out = ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["id", "links", "root"])

    linked = written(dealt.mapInArrow(run, "id long, links long, root long").groupBy("id", "root").agg(F.sum("links").alias("links")))
    together = components(linked, "id", "root")
    links = linked.groupBy("id").agg(F.sum("links").alias("links"))
    known = some.groupBy("hi", "lo").agg(F.min("id").alias("id"), F.count("*").alias("_n"))
    known = known.join(links, "id", "left").join(together.withColumnRenamed("node", "id"), "id", "left")
    known = written(known.select("hi", "lo", "_n", (F.coalesce("links", F.lit(0)) + F.col("_n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    out = join_counted(some, known, ["hi", "lo"], sum(r["count"] for r in counts), spread="id")
    out = out.unionByName(narrow.where(~valid).withColumn("n_links", F.lit(0).cast("long")).withColumn("component_id", F.col("id")))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
