"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before encoding, only where no match of the splitting
pattern can span the cut, so their ids equal those of the uncut text.  A long
run of white space is one match, but for its last character where a visible one
follows; its bytes are merged without the pattern, whose matcher would need a
stack frame for each.

Nulls count as empty text; an empty text has no ids; texts may be of any
length; repeated rows each get their own result; an empty table gives an empty
result.  Only the key and the text are read, so other columns' names can't
clash; a key named ``ids`` or ``decoded`` is refused.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objectlake.llm.common import refuse, texts, worker_memory

#: Characters of text that are encoded at once, if safe boundaries allow it.
PART_CHARS = 1 << 16

#: Between these two characters the pattern always ends a match: what follows a
#: visible character and is white space opens a new match; so does a change
#: from letters or digits to another class, or from other characters to digits.
SAFE = regex.compile(r"(?<=\S)(?=[ \n\t\r])|(?<=\p{L})(?=[^\p{L}\s])|(?<=\p{N})(?=[^\p{N}\s])|(?<=[^\s\p{L}\p{N}])(?=\p{N})")

#: A run of white space of this many characters is encoded by itself.
BLANK = 1 << 10
BLANKS = regex.compile(rf"\p{{White_Space}}{{{BLANK},}}")

_ENCODINGS: dict = {}


def safe_parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Consecutive parts of about ``size`` characters, cut at safe boundaries alone.

    A stretch without such a boundary stays whole, however long it is.
    """
    at = 0
    while len(text) - at > size:
        found = SAFE.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def encoding(rank_path: str, pattern: str):
    """The tiktoken encoding of a rank file, kept for the life of the process."""
    key = (rank_path, pattern)
    if key not in _ENCODINGS:
        import tiktoken

        with open(rank_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _ENCODINGS[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def encode_text(coder, text: str) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit integers."""
    out, at = [], 0

    def plain(some: str) -> None:
        out.extend(np.array(coder.encode_ordinary(part), dtype="<u4").tobytes() for part in safe_parts(some))

    for run in BLANKS.finditer(text):
        plain(text[at : run.start()])
        at = run.end() - (run.end() < len(text))  # the last one may belong to what follows
        out.append(np.array(coder._encode_single_piece(text[run.start() : at]), dtype="<u4").tobytes())
    plain(text[at:])
    return b"".join(out)


def decode_ids(coder, ids: bytes, step: int = 1 << 16) -> bytes:
    """The raw bytes that ids stand for; they need not be valid UTF-8."""
    every = np.frombuffer(ids, dtype="<u4")
    return b"".join(coder.decode_bytes(every[i : i + step].tolist()) for i in range(0, len(every), step))


def encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text", key: str = "doc_id", decode: bool = False) -> DataFrame:
    """Returns the key, ``ids`` (binary, little-endian unsigned 32-bit) and, if asked for, ``decoded`` (binary) of every row."""
    kind = df.schema[key].dataType
    refuse([key], ("ids", "decoded"))
    names = [key, "ids", *(["decoded"] if decode else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory()
        coder = encoding(rank_path, pattern)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                ids = [encode_text(coder, t) for t in texts(part.column(1))]
                columns = [part.column(0), pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array([decode_ids(coder, x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{key}` {kind.simpleString()}, ids binary" + ", decoded binary" * decode
    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def decode(df: DataFrame, rank_path: str, pattern: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """Returns the key and ``decoded`` (binary) of every row of packed ids; null ids decode to no bytes."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(rank_path, pattern)
        for batch in batches:
            out = [decode_ids(coder, x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[key, "decoded"])

    return df.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {kind.simpleString()}, decoded binary")
