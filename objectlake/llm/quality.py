r"""Quality rules and a hashed n-gram classifier.

Words are ``[^\x20\x09-\x0D]+``.  The rules fail a text with few words or with
many words in repeated five-word windows.  What passes is scored by a logistic
regression on hashed words, word pairs and character n-grams of the whole text,
trained on labelled rows, its scores made probabilities on rows that were set
aside (Platt), and kept from a fixed threshold on.

The model is fitted on at most about ``SAMPLE`` labelled documents, drawn by a
hash of the id.  Without labels of both kinds everything that passes the rules
is kept.  Null and empty texts have no words and fail; texts of any length are
measured whole; repeated rows get equal results; of labels with one id, any bad
one counts; a score right at the threshold is kept; an empty table gives an
empty result.  Columns that have the name of a result are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objectlake.llm.common import refuse, texts
from objectlake.llm.features import Sparse, char_counts, fit, normal, platt, sigmoid, thin

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, REPEATED_PERCENT = 10, 20

WORD_BITS, CHAR_BITS, CHAR_ORDERS = 13, 12, (3, 4)
WIDTH = (2 << WORD_BITS) + (len(CHAR_ORDERS) << CHAR_BITS)
SAMPLE = 4000
PENALTY = 3e-4
THRESHOLD = 0.5
CACHE_WORDS = 400_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def hashed(text: str, hashes: WordHashes) -> np.ndarray:
    """A 64-bit hash for each word, in order."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes: ASCII white space alone
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def repeated_words(words: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that are found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = words[:n].copy()
    for i in range(1, window):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += words[i : i + n]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def measures(text: str, words: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    seen: set[str] = set()
    doubled = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line.strip(SPACES):
                doubled += line in seen
                seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), doubled, repeated_words(words)


def vector(text: str, words: np.ndarray) -> np.ndarray:
    """Hashed words, word pairs and character n-grams; each kind has the same length."""
    shift = np.uint64(64 - WORD_BITS)
    odd = np.uint64(0x9E3779B97F4A7C15)
    one = np.bincount(((words * odd) >> shift).astype(np.int64), minlength=1 << WORD_BITS)
    two = np.bincount((((words[:-1] * odd + words[1:]) * odd) >> shift).astype(np.int64), minlength=1 << WORD_BITS)
    chars = char_counts(text, CHAR_ORDERS, CHAR_BITS, False)
    parts = [normal(one), normal(two), normal(chars)]
    return np.concatenate(parts) / np.float32(np.sqrt(len(parts)))


@dataclass
class Model:
    weights: np.ndarray | None = None
    offset: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """The chance that each row is of good quality; 1 if nothing was learned."""
        if self.weights is None:
            return np.ones(len(x))
        a, b = self.scale
        return sigmoid(a * (x @ self.weights + self.offset) + b)


def train(rows: list[tuple[bool, bytes, bytes]]) -> Model:
    """Fits on four rows of five and calibrates on the fifth; classes weigh as they occur."""
    if len({r[0] for r in rows}) < 2:
        return Model()
    y = np.array([1.0 if r[0] else -1.0 for r in rows])
    aside = np.arange(len(rows)) % 5 == 4
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside[:] = False
    x = Sparse([r[1:] for r, out in zip(rows, aside, strict=True) if not out], WIDTH)
    w, b = fit(x, y[~aside], "log", PENALTY)
    held = Sparse([r[1:] for r, out in zip(rows, aside, strict=True) if out], WIDTH) if aside.any() else x
    return Model(w.astype(np.float32), b, platt(held.dot(w) + b, y[aside] if aside.any() else y))


def learn(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", quality: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits a model on a bounded sample of the labelled rows; the sampled labels, bounded too, are broadcast."""
    good = labels.where(F.col(quality).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg((F.min(quality) > 0).alias("good"))
    n = good.count()
    draw = F.pmod(F.xxhash64(F.lit(23), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    chosen = good.where(draw < min(1.0, sample / max(n, 1))).withColumnRenamed(key, "_id")
    rows = df.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id").select("good", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            good_, index, value = [], [], []
            for label, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                at, x = thin(vector(t, hashed(t, hashes)))
                good_.append(label)
                index.append(at)
                value.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(good_, pa.bool_()), pa.array(index, pa.binary()), pa.array(value, pa.binary())], names=["good", "at", "x"])

    return train(sorted(tuple(r) for r in rows.mapInArrow(run, "good boolean, at binary, x binary").collect()))


def assess(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds the measures, ``base_failed``, ``quality_score`` and ``kept`` to the rows of ``df``; the text itself is dropped."""
    place = df.columns.index(text)
    others = [n for n in df.columns if n != text]
    results = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality_score", "kept")
    refuse(others, results)
    names = [*others, *results]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                rows = texts(part.column(place))
                words = [hashed(t, hashes) for t in rows]
                counts = np.array([measures(t, w) for t, w in zip(rows, words, strict=True)], np.int64).reshape(-1, 5)
                failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > REPEATED_PERCENT * counts[:, 0])
                score = model.probability(np.stack([vector(t, w) for t, w in zip(rows, words, strict=True)])) if rows else np.zeros(0)
                kept = ~failed & (score >= threshold)
                columns = [c for i, c in enumerate(part.columns) if i != place]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(counts[:, i]) for i in range(5)], pa.array(failed), pa.array(score.astype(np.float64)), pa.array(kept)], names=names)

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name != text)
    return df.mapInArrow(run, f"{schema}n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality_score double, kept boolean")
