"""Small helpers for the Arrow-batched operators: bounded text chunks and vectorised word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of an Arrow batch of whole texts: both sides of the pipe hold one, so it has to stay small for long texts.
BATCH_ROWS = 1000

#: Bytes of text that one numpy step looks at; a longer single text is one step of its own.
CHUNK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_U = np.uint64


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of the session's Arrow batches by BATCH_ROWS; a smaller bound stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (wrapping arithmetic)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if t is None else t for t in batch.column(name).cast(pa.binary()).to_pylist()]


def chunks(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of ``batch`` with about CHUNK_BYTES of text each, so that temporaries stay small."""
    col = batch.column(name)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
    cut = np.cumsum(sizes) // CHUNK_BYTES
    starts = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:]):
        if b > a:
            part = batch.slice(a, b - a)
            yield part, texts_of(part, name)


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every ASCII-white-space word of all texts, and the word offsets of each text (len + 1)."""
    joined = b"\n".join([*texts, b""])
    buf = np.frombuffer(joined, dtype=np.uint8)
    word = _IS_WORD[buf]
    start = word.copy()
    start[1:] &= ~word[:-1]
    starts = np.flatnonzero(start)
    doc_ends = np.cumsum([len(t) + 1 for t in texts])
    offsets = np.concatenate([[0], np.searchsorted(starts, doc_ends)])
    if not len(starts):
        return np.zeros(0, np.uint64), offsets
    at = np.flatnonzero(word)
    first = np.searchsorted(at, starts)
    lengths = np.diff(np.append(first, len(at)))
    pos = np.arange(len(at)) - np.repeat(first, lengths)
    weights = mix(np.arange(1, int(lengths.max()) + 1, dtype=np.uint64)) | _U(1)
    byte = (_LOWER[buf[at]] if lower else buf[at]).astype(np.uint64) + _U(1)
    return mix(np.add.reduceat(byte * weights[pos], first) + lengths.astype(np.uint64)), offsets
