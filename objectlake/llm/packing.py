"""Best-fit packing of tokenized documents into fixed-length sequences.

Item sizes are whole numbers up to the capacity, so the packing is planned on
the histogram of sizes: at most ``capacity`` counts reach the driver, however
many documents there are.  Items above a third of the capacity are matched
first, greedily and at most two to a bin; the smaller ones then go, largest
first, into the tightest gap.  Bins with the same contents are planned as one
range of bins.  Each piece finds its place by its rank within its size.

Null text counts as empty; an empty document is the single end id.  Texts may be
of any length: pieces are at most ``capacity`` long.  Repeated rows are pieces
of their own, with different places; ties in length are broken by the columns
that order rows.  The strings of special tokens in a text get their special ids,
as the tokenizer's own call gives them; ``plain`` makes them ordinary text.  An
empty table gives an empty result.  Columns that have the name of a result
(``piece``, ``start``, ``length``, ``ids`` as a key; ``sequence_id``, ``offset``,
``rank`` in ``pack``) are refused.
"""

from __future__ import annotations

import bisect
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from objectlake.llm.common import refuse, texts, worker_memory

CAPACITY = 2048
END_ID = 0

#: Rows that one task ranks at most, on average.
RANK_ROWS = 50_000

#: Distinct words whose ids a worker remembers.
CACHE_WORDS = 1_000_000

_TOKENIZERS: dict = {}


def _printable() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary: visible Latin-1 as it is, the others from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class WordEncoder(dict):
    """Encodes texts by a ``tokenizers`` file, word by word, remembering the ids of words.

    Texts are cut before a space or a line feed that follows a visible
    character, where no match of the pre-tokenizer's pattern can span the cut.
    The keys stand for a space and the word, or for the word alone where it
    starts with a line feed.  A value of None says that the word is empty or
    ends in white space, so that the text after it can't be encoded alone.
    """

    def __init__(self, path: str, cache: int = CACHE_WORDS, plain: bool = False) -> None:
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        added = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))).search if added else lambda _: None
        model = json.loads(self.tokenizer.to_str())["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merge = BPE(model["vocab"], merges, cache_capacity=0).tokenize
        self.cache, self.printable = cache, _printable()
        self.single: dict[str, bytes] = {}

    def _letters(self, text: str) -> bytes:
        """The ids of what the pre-tokenizer leaves whole: letters, with a space before them or not."""
        shown = text.encode().decode("latin-1").translate(self.printable)
        return np.array([t.id for t in self.merge(shown)], dtype="<u4").tobytes()

    def _alone(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def __missing__(self, word: str) -> bytes | None:
        if not word or word[-1].isspace():
            ids = None
        elif word.isalpha():
            ids = self._letters(" " + word)
        elif word[:-1].isalpha() and word[-1] in ",.;:!?":  # never part of the letters' match
            if word[-1] not in self.single:
                self.single[word[-1]] = self._alone([word[-1]])[0]
            ids = self[word[:-1]] + self.single[word[-1]]
        else:
            ids = self._alone([word if word[0] == "\n" else " " + word])[0]
        self[word] = ids
        return ids

    def encode(self, many: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self) > self.cache:
            self.clear()
        split = [t.replace("\n", " \n").split(" ") for t in many]
        out, find = [], self.__getitem__
        for text, words, first in zip(many, split, self._alone([words[0] for words in split]), strict=True):
            try:
                if self.special(text):
                    out.append(self._alone([text])[0])
                    continue
                if words[0][-1:].isspace() or not words[0] and text:
                    raise TypeError
                out.append(first + b"".join(map(find, words[1:])))
            except TypeError:  # runs of white space
                out.append(b"".join(self._alone(re.split(r"(?<=\S)(?=[ \n])", text))))
        return out


def tokenizer(path: str, plain: bool = False) -> WordEncoder:
    if (path, plain) not in _TOKENIZERS:
        _TOKENIZERS[path, plain] = WordEncoder(path, plain=plain)
    return _TOKENIZERS[path, plain]


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", key: str = "doc_id", plain: bool = False) -> DataFrame:
    """Tokenizes every text, adds the end id and cuts what is longer than ``capacity``; the first piece takes the odd rest.

    Returns the key, ``piece``, ``start``, ``length`` and ``ids`` (binary, little-endian unsigned 32-bit).
    """
    refuse([key], ("piece", "start", "length", "ids"))
    kind = df.schema[key].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory()
        coder = tokenizer(path, plain)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                of, number, starts, lengths, ids = [], [], [], [], []
                for row, x in enumerate(coder.encode(texts(part.column(1)))):
                    x += end
                    n = len(x) // 4
                    begin = [0, *range(n % capacity or capacity, n, capacity)]
                    for k, (a, b) in enumerate(zip(begin, [*begin[1:], n], strict=True)):
                        of.append(row)
                        number.append(k)
                        starts.append(a)
                        lengths.append(b - a)
                        ids.append(x[4 * a : 4 * b])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(of, pa.int64())), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())],
                    names=[key, "piece", "start", "length", "ids"],
                )

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where the items of each size go: (size, first rank, end rank, first bin, items to a bin, offset).

    ``counts`` has how many items there are of each size from 1 to ``capacity``.
    The plan has a few rows for each size, whatever the counts.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("an item is empty or larger than a bin")
    out: list[tuple[int, int, int, int, int, int]] = []
    ranks: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: ranges of bins
    bins = 0

    def put(size: int, n_bins: int, each: int, first: int, offset: int) -> None:
        out.append((size, ranks[size], ranks[size] + n_bins * each, first, each, offset))
        ranks[size] += n_bins * each
        left[size] -= n_bins * each

    third = capacity // 3
    large = sorted(s for s in left if s > third)
    while large:
        size = large[-1]
        if not left[size]:
            large.pop()
            continue
        # the largest partner that fits; one of the same size needs a second item of it
        at = bisect.bisect_right(large, capacity - size) - 1
        while at >= 0 and (not left[large[at]] or large[at] == size and left[size] < 2):
            if not left[large[at]]:
                large.pop(at)
            at -= 1
        if at < 0:
            n = left[size]
            put(size, n, 1, bins, 0)
            gap = capacity - size
        elif large[at] == size:
            n = left[size] // 2
            put(size, n, 2, bins, 0)
            gap = capacity - 2 * size
        else:
            partner = large[at]
            n = min(left[size], left[partner])
            put(size, n, 1, bins, 0)
            put(partner, n, 1, bins, size)
            gap = capacity - size - partner
        gaps[gap].append((bins, n))
        bins += n

    for size in sorted((s for s in left if s <= third), reverse=True):
        for gap in sorted(g for g in gaps if g >= size):
            each = gap // size
            while left[size] and gaps[gap]:
                first, n = gaps[gap].pop()
                full = min(n, left[size] // each)
                if full:
                    put(size, full, each, first, capacity - gap)
                    gaps[gap - each * size].append((first, full))
                rest = min(left[size], each - 1) if full < n else 0
                if rest:
                    put(size, 1, rest, first + full, capacity - gap)
                    gaps[gap - rest * size].append((first + full, 1))
                if (used := full + bool(rest)) < n:
                    gaps[gap].append((first + used, n - used))
            if not gaps[gap]:
                del gaps[gap]
            if not left[size]:
                break
        if left[size]:
            each = capacity // size
            full, rest = divmod(left[size], each)
            if full:
                put(size, full, each, bins, 0)
                gaps[capacity - each * size].append((bins, full))
                bins += full
            if rest:
                put(size, 1, rest, bins, 0)
                gaps[capacity - rest * size].append((bins, 1))
                bins += 1
    return out


def ranked(df: DataFrame, group: str, *order: str, rows: int = RANK_ROWS) -> DataFrame:
    """Adds ``rank`` from 0 within each value of ``group``, also where one value holds most rows.

    Rows of a group are dealt to several buckets; the rank is that within the
    bucket and the count of the buckets before.  ``order`` decides ties and
    must tell rows apart, up to rows that are the same.
    """
    buckets = max(1, -(-df.count() // rows))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(group, "_bucket").count().select(group, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, "_bucket").orderBy(*order)
    return dealt.withColumn("_rank", F.row_number().over(within) - 1).join(offsets, [group, "_bucket"]).withColumn("rank", (F.col("_rank") + F.col("_before")).cast("long")).drop("_rank", "_before", "_bucket")


def pack(df: DataFrame, keys: list[str], capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to every row of ``df``, whose ``length`` is 1 to ``capacity``.

    ``keys`` name the columns that order rows of one length.  ``df`` is read
    three times: pass a written table where it is dear to compute.
    """
    refuse(df.columns, ("sequence_id", "offset", "rank"))
    counts = {r[0]: r[1] for r in df.groupBy(length).count().collect()}  # at most `capacity` rows
    rows = sorted(plan(counts, capacity))
    sizes = np.array([r[0] for r in rows], dtype=np.int64)
    lows, firsts, each, offsets = (np.array([r[i] for r in rows], dtype=np.int64) for i in (1, 3, 4, 5))
    top = 1 << 42
    at = sizes * top + lows
    names = [*df.columns, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(length).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            k = np.searchsorted(at, size * top + rank, side="right") - 1
            bin_, slot = np.divmod(rank - lows[k], each[k])
            columns = [batch.column(n) for n in names[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(firsts[k] + bin_), pa.array(offsets[k] + slot * size)], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", sequence_id long, offset long"
    return ranked(df, length, *keys).mapInArrow(run, schema)
