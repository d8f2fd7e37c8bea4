"""MinHash near-duplicates: universal hash minima, banding, signature checks, exact checks, components.

A document's set is its distinct five-word shingles, words lower-cased (A to Z)
and split at ASCII white space; fewer words are one shingle.  Equal sets are
one class, of which the smallest id stands for all, so copies are never paired.
Documents that share a band of the signature are a bucket, and are tied to the
smallest of them, its top.  First each document goes with its smallest top
alone: those of one top are dealt to blocks, each with the top, and compared in
their block, by signature first, then on the full sets, but for pairs that are
joined already.  Then all that are tied to one top are a group; where not all of
a group are joined by now, and some of its pairs have not met, members outside
its largest component are compared with all others, in blocks, each pair of
blocks in a task of its own.  So the work of chains of buckets grows with their
members alone.  Tasks return a forest of confirmed links, not pairs.

Null or empty texts have no shingles and link with nothing.  Ids are integers
and tell documents apart: rows that share one must be the same row.  Rows
without an id take part in no group.  Only the id and the text are read, so
other columns' names can't clash.  Texts of any length are shingled whole.  An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objectlake.llm.common import join_counted, likely, partitions, raw, temporary, written
from objectlake.llm.components import components

WORDS = 5

#: A pair right at the similarity asked for shares no band with this chance, at most.
MISS = 5e-5

#: Minima in a signature, at most, where the similarity asked for is not very low.
HASHES = 126

#: Documents and shingles in a block, at most on average.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 19

#: Words whose hashes a worker remembers.
CACHE_WORDS = 500_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def bands_rows(num: int, den: int) -> tuple[int, int]:
    """Bands and rows of the signature: the most rows whose bands miss no more than ``MISS`` with up to ``HASHES`` minima; 21 and 6 at 0.85."""
    best = 1, HASHES
    for rows in range(1, HASHES + 1):
        alike = (num / den) ** rows
        bands = max(1, math.ceil(math.log(MISS) / math.log1p(-alike))) if alike < 1 else 1
        if rows == 1 or bands * rows <= HASHES:
            best = bands, rows
    return best


def slack(num: int, den: int, hashes: int) -> float:
    """A pair is dropped by its signatures if they agree this much less than asked for: four standard deviations, rounded up; 0.13 at 0.85."""
    return math.ceil(400 * math.sqrt(num * (den - num) / hashes) / den) / 100


@lru_cache(maxsize=4)
def universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``n`` hash functions multiply by and add."""
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles."""
    split = text.lower().split()  # bytes: A to Z and ASCII white space alone
    if not split:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, split), np.uint64, len(split))
    n = max(1, len(w) - words + 1)
    h = w[:n].copy()
    for i in range(1, min(words, len(w))):
        h *= _BASE
        h += w[i : i + n]
    return np.unique(mixed(h + np.uint64(min(words, len(w)))))


def signature(h: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """The minima of universal hashes (multiply, add, shift), of which 16 bits are kept."""
    multiply, add = universal(hashes)
    out = np.full(hashes, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 512):
        out = np.minimum(out, ((h[i : i + 512] * multiply[:, None] + add[:, None]) >> np.uint64(32)).astype(np.uint32).min(axis=1))
    return out.astype(np.uint16)


def signed(df: DataFrame, text: str = "text", key: str = "doc_id", minima: int = HASHES) -> DataFrame:
    """The key, ``n_shingles``, a 128-bit digest of the set (``hi``, ``lo``) and the signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, hi, lo, sig = [], [], [], []
            for t in raw(batch.column(1)):
                if len(hashes) > CACHE_WORDS:
                    hashes.clear()
                h = shingles(t, hashes)
                d = xxhash.xxh3_128_digest(h.tobytes())
                n.append(len(h))
                hi.append(int.from_bytes(d[:8], "little", signed=True))
                lo.append(int.from_bytes(d[8:], "little", signed=True))
                sig.append(signature(h, minima).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sig, pa.binary())], names=["id", "n_shingles", "hi", "lo", "sig"])

    return df.select(F.col(key).cast("long").alias("id"), F.col(text)).mapInArrow(run, "id long, n_shingles long, hi long, lo long, sig binary")


def banded(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """A row (id, band) for each band of a signature; the number of the band is part of its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(ids), bands, rows)
            h = np.broadcast_to(salt, (len(ids), bands)).copy()
            for i in range(rows):
                h = mixed(h * _BASE + sig[:, :, i])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, bands)), pa.array(h.ravel().view(np.int64))], names=["id", "band"])

    return reps.select("id", "sig").mapInArrow(run, "id long, band long")


class Forest:
    """Union-find over local numbers."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def confirmed(own: np.ndarray, others: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which of the other sets have den * intersection >= num * union with ``own``."""
    sizes = np.array([len(o) for o in others])
    every = np.concatenate(others)
    at = np.searchsorted(own, every)
    hit = own[np.minimum(at, len(own) - 1)] == every
    shared = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return den * shared >= num * (len(own) + sizes - shared)


def links(ids: list[int], sides: np.ndarray, sets: list[np.ndarray], across: bool, num: int, den: int, joined: list[int] | None = None) -> list[tuple[int, int]]:
    """A forest of confirmed links among the members of a block, or between two blocks.

    Members that agree with many are compared first, so that most are joined
    early; pairs that are joined already, here or by equal values of ``joined``, are not compared.
    """
    n = len(ids)
    minima = math.prod(bands_rows(num, den))
    sigs = np.stack([signature(s, minima) for s in sets])
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    least = (num / den - slack(num, den, minima)) * minima
    forest = Forest(n)
    first: dict[int, int] = {}
    for i, component in enumerate(joined or ()):
        forest.join(i, first.setdefault(component, i))
    start = [forest.find(i) for i in range(n)]

    def near(i: int) -> np.ndarray:
        ok = (den * np.minimum(sizes, sizes[i]) >= num * np.maximum(sizes, sizes[i])) & (np.arange(n) != i)
        if across:
            ok &= sides != sides[i]
        js = np.flatnonzero(ok)
        agree = (sigs[js] == sigs[i]).sum(axis=1)
        js, agree = js[agree >= least], agree[agree >= least]
        return js[np.argsort(-agree, kind="stable")]

    found: list[tuple[int, int]] = []
    around = [near(i) for i in range(n)] if n <= 4096 else None
    order = sorted(range(n), key=lambda i: -len(around[i])) if around else range(n)
    done = np.zeros(n, bool)
    for i in order:
        js = around[i] if around else near(i)
        js = [j for j in js.tolist() if not done[j]]
        done[i] = True
        while js:
            root = forest.find(i)
            js = [j for j in js if forest.find(j) != root]
            now, js = js[:64], js[64:]
            if not now:
                break
            for j, yes in zip(now, confirmed(sets[i], [sets[j] for j in now], num, den), strict=True):
                if yes:
                    forest.join(i, j)
    for i in range(n):
        root = forest.find(i)
        if start[i] == i and root != i:
            found.append((ids[i], ids[root]))
    return found


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of each group, from batches that are sorted by their first ``keys`` columns."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:keys] != at:
                if rows:
                    yield at, rows
                at, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield at, rows


def _blocks(n: Column, weight: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK_DOCS), F.ceil(weight / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _compared(rows: DataFrame, parts: int, num: int, den: int) -> DataFrame:
    """The forests (a, b) of groups: rows (top, x, y, side, joined, id, set), where only pairs of different sides count if x and y differ."""
    dealt = rows.select("top", "x", "y", "id", "side", "joined", "set").repartition(parts, "top", "x", "y").sortWithinPartitions("top", "x", "y", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, x, y), group in grouped(batches, 3):
            if len(group) < 2:
                continue
            sets = [np.frombuffer(r[3], np.uint64) for r in group]
            out = links([r[0] for r in group], np.array([r[1] for r in group]), sets, x != y, num, den, [r[2] for r in group])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def linked(ties: DataFrame, members: DataFrame, parts: int, num: int, den: int) -> DataFrame:
    """Rows (node, component) of confirmed links among the documents of each top.

    ``ties`` has (id, top) once, ``members`` (id, n_shingles, set) of all ids and tops.
    """
    sizes, sets = members.select("id", "n_shingles"), members.select("id", "set")
    first = ties.groupBy("id").agg(F.min("top").alias("top"))
    tops = first.join(sizes, "id").groupBy("top").agg(F.count("*").alias("_n"), F.sum("n_shingles").alias("_w"))
    tops = written(tops.select("top", "_n", _blocks(F.col("_n"), F.col("_w")).alias("_blocks")), F.sum("_n").alias("n"))
    dealt = join_counted(first, tops, "top", tops.facts["n"] or 0, spread="id").select("id", "top", F.pmod(F.xxhash64("id", "top"), F.col("_blocks")).cast("int").alias("x"))
    dealt = written(dealt.unionByName(tops.select(F.col("top").alias("id"), "top", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("x"))))
    placed = dealt.join(sets, "id").withColumn("y", F.col("x")).withColumn("side", F.lit(0)).withColumn("joined", F.col("id"))
    together = written(components(_compared(placed, parts, num, den)))
    # groups that are not of one component, unless all their pairs have met
    some = ties.union(ties.select(F.col("top").alias("id"), "top").distinct())
    some = some.join(together.withColumnRenamed("node", "id"), "id", "left").select("id", "top", F.coalesce("component", "id").alias("joined"))
    some = written(some.join(sizes, "id").join(dealt.select("id", "top", "x", F.lit(True).alias("_met")).dropDuplicates(["id", "top"]), ["id", "top"], "left"))
    groups = some.groupBy("top", "joined").agg(F.count("*").alias("_n"), F.sum("n_shingles").alias("_w"), F.count("_met").alias("_met"), F.max("x").alias("_x"))
    order = F.struct("_n", "joined")
    main = groups.groupBy("top").agg(F.max_by("joined", order).alias("_main"), F.max_by("_n", order).alias("_mn"), F.max_by("_w", order).alias("_mw"), F.sum("_n").alias("_n"), F.sum("_w").alias("_w"), F.sum("_met").alias("_met"), F.max("_x").alias("_x"))
    main = main.where("_n > _mn and (_met < _n or _x > 0)")
    whole = _blocks(F.col("_n"), F.col("_w")) == 1  # a small group is one block
    few = F.when(whole, 1).otherwise(_blocks(F.col("_n") - F.col("_mn"), F.col("_w") - F.col("_mw")))
    main = main.select("top", "_main", "_n", few.cast("int").alias("_few"), F.when(whole, 0).otherwise(_blocks(F.col("_mn"), F.col("_mw"))).cast("int").alias("_wide"))
    main = written(main, F.sum("_n").alias("n"))
    if not main.facts["n"]:
        return together
    # blocks 0 to _few - 1 hold what is outside the largest component, the others that component; pairs of the latter are left out
    apart = (F.col("joined") != F.col("_main")) | (F.col("_wide") == 0)
    here = join_counted(some.select("id", "top", "joined"), main, "top", main.facts["n"], spread="id")
    h = F.xxhash64(F.lit(3), "id")
    here = here.withColumn("side", F.when(apart, F.pmod(h, F.col("_few"))).otherwise(F.col("_few") + F.pmod(h, F.col("_wide"))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.when(apart, F.col("_few") + F.col("_wide")).otherwise(F.col("_few")).cast("int") - 1))
    here = here.withColumn("_o", other).withColumn("x", F.least("side", "_o")).withColumn("y", F.greatest("side", "_o"))
    more = _compared(here.select("id", "top", "x", "y", "side", "joined").join(sets, "id"), parts, num, den)
    return written(components(more.unionByName(together.select(F.col("node").alias("a"), F.col("component").alias("b")))))


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", num: int = 85, den: int = 100) -> DataFrame:
    """The key (as ``doc_id``), ``n_shingles``, ``component_id`` and ``kept`` of every row.

    Two documents link if den * intersection >= num * union of their sets.
    """
    n_bands, n_rows = bands_rows(num, den)
    every = written(signed(df, text, key, n_bands * n_rows))
    some = every.where("id is not null and n_shingles > 0")
    classes = some.groupBy("hi", "lo").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.count("*").alias("_n"))
    classes = written(classes, F.sum("_n").alias("n"))
    with temporary() as keep:
        together = _together(df, text, key, classes, n_bands, n_rows, num, den)
        keep(together)
    reps = classes.select("hi", "lo", "_n", F.col("id").alias("_rep")).join(together.withColumnRenamed("node", "_rep"), "_rep", "left")
    out = join_counted(some.drop("sig"), reps, ["hi", "lo"], classes.facts["n"] or 0, spread="id").withColumn("component_id", F.coalesce("component", "_rep"))
    alone = every.where("id is null or n_shingles = 0").withColumn("component_id", F.col("id"))  # no join: empty texts may be many, and of one digest
    out = out.select("id", "n_shingles", "component_id").unionByName(alone.select("id", "n_shingles", "component_id"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _together(df: DataFrame, text: str, key: str, classes: DataFrame, n_bands: int, n_rows: int, num: int, den: int) -> DataFrame:
    """Rows (node, component) of the classes that link with others; written."""
    spark = df.sparkSession
    bands = written(banded(classes, n_bands, n_rows))
    tops = written(bands.groupBy("band").agg(F.min("id").alias("top"), F.count("*").alias("_n")).where("_n > 1"), F.sum("_n").alias("n"))
    ties = written(join_counted(bands, tops, "band", tops.facts["n"] or 0, spread="id").where("id != top").select("id", "top").distinct())
    wanted = ties.select("id").union(ties.select("top")).distinct()
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("_text"))
    members = written(_sets(likely(rows, wanted).join(wanted, "id").select("id", "_text").dropDuplicates(["id"])), F.sum("n_shingles").alias("n"))
    parts = max(4 * spark.sparkContext.defaultParallelism, partitions(spark, 8 * (members.facts["n"] or 0)))
    return linked(ties, members, parts, num, den)


def _sets(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = []
            for t in raw(batch.column(1)):
                if len(hashes) > CACHE_WORDS:
                    hashes.clear()
                sets.append(shingles(t, hashes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "n_shingles", "set"])

    return rows.mapInArrow(run, "id long, n_shingles long, set binary")
