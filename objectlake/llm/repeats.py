"""Repeated byte strings, found on an enhanced suffix array of sampled suffixes.

Texts are sampled at anchors: of the 32-byte strings in every window of
``length`` bytes, the one with the smallest hash, leftmost if tied.  Equal
windows have equal anchors at equal places, so every repeated string of that
length is found among the suffixes that start at anchors with the same bytes,
and every anchor stands for the windows around it.

1. Rows are numbered, and their texts compressed, shuffled by that number and
   written, once; all that follows is joined to that copy.
2. Anchors are dealt by their hash; those that occur once can repeat nothing.
   Occurrences with the same surroundings (all windows that hold the anchor)
   are one suffix with a multiplicity, for which one of them stands.
3. The different suffixes of an anchor are sorted: a suffix array, with the
   lengths of common prefixes of neighbours.  A scan with a stack visits the
   tree of common-prefix intervals.  Within an interval the suffixes are put in
   the order of what precedes the anchor, and the tree of that order has the
   groups; one whose members are extended to the left by different bytes, or an
   end, is a maximal repeat group with all its members.
4. What the groups cover goes to all occurrences of their members.  A
   document's repeated stretches are merged and returned, or removed.

Occurrences that are alike are merged within an Arrow batch before the shuffle
by anchor, and one suffix answers for ``SEGMENT`` of them at most after it, so
a passage in a third of all documents meets in no task.  Anchors with more than
``GROUP`` different suffixes are divided over tasks by the same tree: an
interval that is too large is a group whose common bytes on both sides come
from its least and greatest members, and the next byte on either side deals its
members to the intervals below, until they are small enough to be sorted.

Null text is empty.  Rows are told apart by their number alone: ids may be of
any type, repeated or null, and the same row counts as often as it is there.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objectlake.llm.common import bucketed, partitions, raw, written

LENGTH = 200
GRAM = 32

#: Different suffixes of one anchor that are sorted in one task, at most.
GROUP = 50_000

#: Occurrences of one suffix that take what it covers from one row, at most.
SEGMENT = 4096

#: Window starts for which anchors are sought at once; a place in such a stretch fits into the low bits of a key.
STRETCH = 1 << 18
_PLACE = np.uint64((1 << 20) - 1)

_rng = np.random.default_rng(71)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << i, 1 << 64)) for i in range(5)]
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def anchors(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of the anchors of all windows, ascending, with the starts of the first and the last window of each.

    An anchor's windows follow each other.
    """
    n = len(text)
    if n < length:
        return (np.zeros(0, np.int64),) * 3
    data, width = np.frombuffer(text, np.uint8), length - GRAM + 1
    found = []
    for at in range(0, n - length + 1, STRETCH):
        h = _BYTE[data[at : at + STRETCH + length - 1]]
        for i, power in enumerate(_POWERS):  # doubles the length that is hashed, to 32
            step = 1 << i
            h = h[:-step] * power + h[step:]
        h ^= h >> np.uint64(31)
        h *= _MIX
        h &= ~_PLACE
        h |= np.arange(len(h), dtype=np.uint64)
        step, done = 1, h
        while 2 * step <= width:
            done = np.minimum(done[:-step], done[step:])
            step *= 2
        if step < width:
            done = np.minimum(done[: len(h) - width + 1], done[width - step :])
        first = np.concatenate([[0], np.flatnonzero(done[1:] != done[:-1]) + 1])
        found.append(((done[first] & _PLACE).astype(np.int64) + at, first + at, np.append(first[1:], len(done)) - 1 + at))
    places, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(found) > 1:  # an anchor with windows in two stretches
        new = np.concatenate([[True], places[1:] != places[:-1]])
        first, last = first[new], np.maximum.reduceat(last, np.flatnonzero(new))
        places = places[new]
    return places, first, last


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# ---- the enhanced suffix array ---------------------------------------------------------


def common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int, list[int]]]:
    """The common-prefix intervals of sorted strings, by a scan with a stack: (first, last, length, members of none below), children first."""
    stack: list[tuple[int, int, list[int]]] = []  # (length, first, members of none below)
    for i in range(len(lcp) + 1):
        after = lcp[i] if i < len(lcp) else -1
        if after > (stack[-1][0] if stack else -1):
            stack.append((after, i, [i]))
            continue
        if stack:
            stack[-1][2].append(i)
        while stack and stack[-1][0] > after:
            length, first, own = stack.pop()
            yield first, i, length, own
            if after > (stack[-1][0] if stack else -1):
                stack.append((after, first, []))


class Group:
    """The suffixes of one anchor: what follows it and, read backwards, what precedes it, and how often each occurs."""

    def __init__(self, backs: list[bytes], afters: list[bytes], times: list[int]) -> None:
        order = sorted(range(len(afters)), key=afters.__getitem__)  # the suffix array
        self.order = np.array(order, np.int64)
        self.after, self.back, self.times = ([x[i] for i in order] for x in (afters, backs, times))
        self.lcp = [common(a, b) for a, b in pairwise(self.after)]
        by_back = sorted(range(len(order)), key=self.back.__getitem__)
        self.rank, self.near = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        self.rank[by_back] = np.arange(len(order))
        for a, b in pairwise(by_back):  # the most that any other suffix shares to the left
            n = common(self.back[a], self.back[b])
            self.near[a], self.near[b] = max(self.near[a], n), max(self.near[b], n)

    def diverse(self, members: np.ndarray, before: int) -> bool:
        """Whether the members, in the order of what precedes them, are extended to the left by different bytes or an end."""
        left, right = (self.back[members[i]][before : before + 1] for i in (0, -1))
        return not left or left != right

    def maximal(self, least: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Maximal repeat groups of ``least`` bytes: (bytes before the anchor, bytes after it, all members, members of no group inside).

        A suffix that occurs more than once is a group of its own.  Groups come
        after those inside them.
        """
        for i in np.flatnonzero(np.array(self.times) > 1):
            if len(self.back[i]) + len(self.after[i]) >= least:
                yield len(self.back[i]), len(self.after[i]), self.order[i : i + 1], self.order[i : i + 1]
        for first, last, after, _ in intervals(self.lcp):
            rows = first + np.flatnonzero(self.near[first : last + 1] + after >= least)
            if len(rows) < 2:
                continue
            rows = rows[np.argsort(self.rank[rows])]
            shared = [common(self.back[a], self.back[b]) for a, b in pairwise(rows.tolist())]
            for lo, hi, before, own in intervals(shared):
                if before + after >= least and self.diverse(rows[lo : hi + 1], before):
                    yield before, after, self.order[rows[lo : hi + 1]], self.order[rows[own]]

    def covered(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """How far to the left and right of the anchor each suffix is covered by maximal repeats; both 0 if by none."""
        left, right = np.zeros(len(self.order), np.int64), np.zeros(len(self.order), np.int64)
        for before, after, _, own in self.maximal(least):
            left[own] = np.maximum(left[own], before)
            right[own] = np.maximum(right[own], after)
        return left, right


# ---- on tables --------------------------------------------------------------------------


def _stored(df: DataFrame, text: str, carry: tuple[str, ...]) -> DataFrame:
    """(k, z, carried): a number for each row, its text, compressed, and the columns that go along; by k."""
    carried = F.struct(*carry).alias("carried")
    rows = df.select(F.monotonically_increasing_id().alias("k"), F.coalesce(F.col(text), F.lit("")).alias("_text"), carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press.compress(t) for t in raw(batch.column(1))], pa.binary()), batch.column(2)], names=["k", "z", "carried"])

    return bucketed(rows.mapInArrow(run, f"k long, z binary, carried {rows.schema['carried'].dataType.simpleString()}"), "k")


def _unpacked(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def _place(packed: int, length: int) -> tuple[int, int, int]:
    """An anchor's place, and start and end of all its windows."""
    at = packed >> 17
    start = at - (packed >> 9 & 255)
    return at, start, start + (packed >> 1 & 255) + length


def _sample(stored: DataFrame, length: int) -> DataFrame:
    """Rows of anchors: a, the hash of its bytes, c, that of its surroundings, k, at, s.

    ``at`` holds the place, how far before it its first window starts, how far
    its windows start apart, and whether one batch has the surroundings more
    than once.  Of such, one row leads; the others follow: they have -1 - ``at``,
    and in ``s`` the k of their leader.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, c, k, at = [], [], [], []
            for key, z in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                text = _unpacked(z)
                places, first, last = anchors(text, length)
                for p, start, end in zip(places.tolist(), first.tolist(), (last + length).tolist(), strict=True):
                    a.append(xxhash.xxh3_64_intdigest(text[p : p + GRAM]))
                    c.append(xxhash.xxh3_64_intdigest(text[start:end], p - start))
                k += [key] * len(places)
                at.append((((places << 8) + (places - first) << 8) + (last - first)) << 1)
            if not a:
                continue
            a, c = np.array(a, np.uint64).view(np.int64), np.array(c, np.uint64).view(np.int64)
            k, at = np.array(k, np.int64), np.concatenate(at)
            order = np.lexsort((c, a))
            new = np.ones(len(order), bool)
            new[1:] = (a[order][1:] != a[order][:-1]) | (c[order][1:] != c[order][:-1])
            group = np.cumsum(new) - 1
            lead, rest = order[new], order[~new]
            rows = np.concatenate([lead, rest])
            places = np.concatenate([at[lead] + (np.bincount(group) > 1), -1 - at[rest]])
            of = np.concatenate([np.zeros(len(lead), np.int64), k[lead][group[~new]]])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[rows], c[rows], k[rows], places, of)], names=["a", "c", "k", "at", "s"])

    return stored.select("k", "z").mapInArrow(run, "a long, c long, k long, at long, s long")


def _occurrences(samples: DataFrame) -> DataFrame:
    """Of anchors that occur again: (a, c, k, at, s, n).

    ``n`` is 1 or, for more, 2 where the row stands for all with its (a, c, s);
    0 where another row, with k = s, does; -1 for those that follow a leader, which has k = s.
    """
    follows = F.col("at") < 0
    rows = samples.repartition(partitions(samples.sparkSession), F.when(follows, F.xxhash64("k", "at")).otherwise(F.col("a"))).sortWithinPartitions(follows, "a", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held = None, None  # the row before, with its place in its segment and what stands for it; rows whose next one isn't known

        def judged(cols: list[np.ndarray], final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal before
            a, c, k, at, s = cols
            lead = int((at >= 0).sum())  # followers come last
            out = [x[lead:] for x in cols]
            if lead:
                a, c, k, at = a[:lead], c[:lead], k[:lead], at[:lead]
                same_a, same_c = np.zeros(lead, bool), np.zeros(lead, bool)
                same_a[1:] = a[1:] == a[:-1]
                same_c[1:] = same_a[1:] & (c[1:] == c[:-1])
                if before is not None:
                    same_a[0] = a[0] == before[0]
                    same_c[0] = same_a[0] and c[0] == before[1]
                at_run = np.maximum.accumulate(np.where(same_c, -1, np.arange(lead)))
                place = np.arange(lead) - np.maximum(at_run, 0) + np.where(at_run < 0, before[2] + 1 if before else 0, 0)
                stands = place % SEGMENT == 0
                by = np.maximum.accumulate(np.where(stands, np.arange(lead), -1))
                of = np.where(by < 0, before[3] if before else 0, k[np.maximum(by, 0)])
                done = lead if final or lead < len(cols[0]) else lead - 1
                again_c = same_c | np.append(same_c[1:], False) | (at & 1 == 1)
                keep = (same_a | np.append(same_a[1:], False) | (at & 1 == 1))[:done]
                n = np.where(stands, 1 + again_c, 0)
                if done:
                    before = (int(a[done - 1]), int(c[done - 1]), int(place[done - 1]), int(of[done - 1]))
                    yield batch_of([x[:done][keep] for x in (a, c, k, at, of, n)])
            if len(out[0]):
                yield batch_of([*out[:3], -1 - out[3], out[4], np.full(len(out[0]), -1)])

        def batch_of(cols: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in cols[:5]], pa.array(cols[5], pa.int32())], names=["a", "c", "k", "at", "s", "n"])

        for batch in batches:
            cols = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            if not len(cols[0]):
                continue
            if held:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            yield from judged(cols, False)
            held = [x[-1:] for x in cols] if cols[3][-1] >= 0 else None
        if held:
            yield from judged(held, True)

    return rows.mapInArrow(run, "a long, c long, k long, at long, s long, n int")


def _suffixes(stored: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """Cut from the texts, for each row that stands for others or itself: (a, c, s, n, back, after); ``back`` is read backwards."""
    wanted = found.where("n > 0").groupBy("k").agg(F.collect_list(F.struct("at", "n")).alias("flags"))
    both = stored.select("k", "z").join(wanted.hint("shuffle_hash"), "k").select("k", "z", "flags.at", "flags.n")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in kinds]

        def filled() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=["a", "c", "s", "n", "back", "after"])
            for x in columns:
                x.clear()
            return out

        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                for key, z, places, times in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    text = _unpacked(z)
                    for packed, n in zip(places, times, strict=True):
                        p, start, end = _place(packed, length)
                        row = (_signed(xxhash.xxh3_64_intdigest(text[p : p + GRAM])), _signed(xxhash.xxh3_64_intdigest(text[start:end], p - start)), key, n, text[start:p][::-1], text[p:end])
                        for x, value in zip(columns, row, strict=True):
                            x.append(value)
                    if len(columns[0]) > 5_000:
                        yield filled()
        yield filled()

    return both.mapInArrow(run, "a long, c long, s long, n int, back binary, after binary")


def _covered(suffixes: DataFrame, length: int, group: str = "a") -> DataFrame:
    """(a, c, s, lo, hi): how far before and after the anchor each suffix is covered; ``group`` says which are sorted together."""
    rows = suffixes.select(F.col(group).alias("g"), "a", "c", "s", "n", "back", "after").repartition(partitions(suffixes.sparkSession), "g").sortWithinPartitions("g", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in range(5)]

        def filled() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["a", "c", "s", "lo", "hi"])
            for x in columns:
                x.clear()
            return out

        def close(held: list) -> None:
            """``held``: [a, c, all s, n, back, after]."""
            if len(held) < 2 and not (held and held[0][3] > 1):
                return
            left, right = Group([r[4] for r in held], [r[5] for r in held], [r[3] for r in held]).covered(length)
            for (a, c, every, *_), lo, hi in zip(held, left.tolist(), right.tolist(), strict=True):
                if hi:
                    for s in every:
                        for x, value in zip(columns, (a, c, s, lo, hi), strict=True):
                            x.append(value)

        at, held = None, []
        for batch in batches:
            for g, a, c, s, n, back, after in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if g != at:
                    close(held)
                    at, held = g, []
                if held and held[-1][1] == c and held[-1][0] == a:  # the same suffix from another segment
                    held[-1][2].append(s)
                    held[-1][3] = 2
                else:
                    held.append([a, c, [s], n, back, after])
            if len(columns[0]) > 10_000:
                yield filled()
        close(held)
        yield filled()

    return rows.mapInArrow(run, "a long, c long, s long, lo long, hi long")


def _shared(nodes: DataFrame) -> DataFrame:
    """(node, b, e): the bytes that all members of an interval share on either side, from the least and the greatest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, *ends = [x.to_pylist() for x in batch.columns]
            b, e = [common(x, y) for x, y in zip(*ends[:2], strict=True)], [common(x, y) for x, y in zip(*ends[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(b, pa.int32()), pa.array(e, pa.int32())], names=["node", "b", "e"])

    return nodes.select("node", "b0", "b1", "e0", "e1").mapInArrow(run, "node long, b int, e int")


def _divided(suffixes: DataFrame, length: int) -> DataFrame:
    """As ``_covered``, for anchors with more suffixes than one task sorts.

    Intervals that are too large are divided level by level.  All members of
    one are covered by what they share; the next byte after it deals them to
    the intervals below, and the next byte before it to groups within, which
    are divided by what precedes them alone: the tree of the one within the
    intervals of the other, as one task would visit it.
    """
    live = suffixes.groupBy("a", "c").agg(F.first("back").alias("back"), F.first("after").alias("after"), F.max("n").alias("_n"), F.count("*").alias("_m"))
    times = F.when((F.col("_m") > 1) | (F.col("_n") > 1), 2).otherwise(1).cast("int")
    live = written(live.select("a", "c", "back", "after", times.alias("n"), F.col("a").alias("node"), F.lit(False).alias("within")))
    every, covers = live, []
    while True:
        ends = [F.min("back").alias("b0"), F.max("back").alias("b1"), F.min("after").alias("e0"), F.max("after").alias("e1")]
        large = written(_shared(live.groupBy("node").agg(F.count("*").alias("_n"), *ends).where(F.col("_n") > GROUP)))
        small = live.join(large, "node", "left_anti").withColumn("s", F.lit(0).cast("long"))
        covers.append(_covered(small, length, "node").select("a", "c", "lo", "hi"))
        if large.isEmpty():
            break
        members = live.join(large, "node")
        covers.append(members.where(F.col("b") + F.col("e") >= length).select("a", "c", F.col("b").cast("long").alias("lo"), F.col("e").cast("long").alias("hi")))
        after, back = F.expr("substring(after, e + 1, 1)"), F.expr("substring(back, b + 1, 1)")
        below = members.where(~F.col("within") & (F.octet_length("after") > F.col("e"))).withColumn("node", F.xxhash64("node", F.lit(1), after))
        inside = members.where(F.octet_length("back") > F.col("b")).withColumn("node", F.xxhash64("node", F.lit(2), back)).withColumn("within", F.lit(True))
        live = written(below.unionByName(inside).select(*every.columns))
    covers.append(every.where("n > 1").select("a", "c", F.octet_length("back").cast("long").alias("lo"), F.octet_length("after").cast("long").alias("hi")))
    most = covers[0]
    for more in covers[1:]:
        most = most.unionByName(more)
    most = most.groupBy("a", "c").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    return suffixes.select("a", "c", "s").join(most, ["a", "c"]).select("a", "c", "s", "lo", "hi")


def repeated_spans(stored: DataFrame, length: int = LENGTH) -> DataFrame:
    """For each k of ``_stored`` with any, the repeated stretches ``spans``: arrays of (start, end), in bytes, not merged."""
    found = written(_occurrences(_sample(stored, length)))
    suffixes = _suffixes(stored, found, length)
    hot = found.where("n > 0").groupBy("a").agg(F.count("*").alias("_n")).where(F.col("_n") > GROUP).select("a")
    if hot.isEmpty():
        cover = written(_covered(suffixes, length))
    else:
        hot, suffixes = written(hot), written(suffixes)
        cover = _covered(suffixes.join(hot, "a", "left_anti"), length).unionByName(_divided(suffixes.join(hot, "a"), length))
        cover = written(cover)
    place = F.shiftright("at", 17)
    key = ["a", "c", "s"]
    direct = found.where("n >= 0").join(cover, key).select("a", "c", "k", "at", "lo", "hi")
    leaders = direct.where(F.col("at").bitwiseAND(F.lit(1)) == 1).select("a", "c", F.col("k").alias("s"), "lo", "hi")
    every = direct.select("k", "at", "lo", "hi").unionByName(found.where("n < 0").join(leaders, key).select("k", "at", "lo", "hi"))
    spans = every.select("k", (place - F.col("lo")).alias("start"), (place + F.col("hi")).alias("end"))
    return spans.groupBy("k").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def removed(df: DataFrame, text: str = "text", length: int = LENGTH, as_text: bool = False, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For every row ``n_bytes``, ``n_removed``, ``starts`` and ``ends`` (of the merged runs), ``kept``, the bytes that stay, and ``carried``.

    ``carried`` is a struct of the columns that ``carry`` names, so no name can
    clash.  ``as_text`` returns ``kept`` as a string, without what a run has
    left of a character.
    """
    kind = pa.string() if as_text else pa.binary()
    stored = _stored(df, text, carry)
    spans = repeated_spans(stored, length)
    both = stored.join(spans.hint("shuffle_hash"), "k", "left").select("z", "spans.start", "spans.end", "carried")
    names = ["n_bytes", "n_removed", "starts", "ends", "kept", "carried"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                size, gone, starts, ends, kept = [], [], [], [], []
                for z, s, e in zip(*[c.to_pylist() for c in part.columns[:3]], strict=True):
                    whole = _unpacked(z)
                    runs = merged(list(zip(s or [], e or [], strict=True)))
                    at, stay = 0, []
                    for a, b in runs:
                        stay.append(whole[at:a])
                        at = b
                    stay.append(whole[at:])
                    size.append(len(whole))
                    gone.append(sum(b - a for a, b in runs))
                    starts.append([a for a, _ in runs])
                    ends.append([b for _, b in runs])
                    stay = b"".join(stay)
                    kept.append(stay.decode(errors="ignore") if as_text else stay)
                yield pa.RecordBatch.from_arrays([pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(kept, kind), part.column(3)], names=names)

    return both.mapInArrow(run, "n_bytes long, n_removed long, starts array<long>, ends array<long>, kept " + ("string" if as_text else "binary") + f", carried {stored.schema['carried'].dataType.simpleString()}")
