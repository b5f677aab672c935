"""Small per-text helpers that run inside Spark's Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, as ``bytes.split()`` takes it: x20, x09-x0D.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def space_words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and splits at ASCII white space; null has no words."""
    return text.encode().translate(LOWER).split() if text else []


#: Keeps 0-9, a-z and every byte of a non-ASCII character, lower-cases A-Z; all else separates.
_ALNUM = bytes(
    b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def alnum_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_ALNUM).split() if text else []


#: Bytes of texts that a task turns into Python objects at a time, unless it says otherwise.
MOST = 4 << 20


def parts(batches: Iterator[pa.RecordBatch], text_at: int | str, most: int = MOST) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose column ``text_at`` holds about ``most`` bytes, one row at least: Python objects are made a slice at a time."""
    for batch in batches:
        column = batch.column(text_at)
        if pa.types.is_list(column.type):
            sizes = pc.multiply(pc.list_value_length(column), 8)
        else:
            sizes = pc.binary_length(column)
        ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, in column order, made a few at a time."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)


def chunks(batches: Iterator[pa.RecordBatch], text_at: int, most: int = MOST) -> Iterator[list[tuple]]:
    """Rows in lists whose texts hold about ``most`` bytes, so that memory follows this bound and not the batch."""
    for part in parts(batches, text_at, most):
        yield list(zip(*(c.to_pylist() for c in part.columns), strict=True))


def beside(part: pa.RecordBatch, new: pa.RecordBatch) -> pa.RecordBatch:
    """The columns of both; names may repeat, Spark goes by place."""
    return pa.RecordBatch.from_arrays([*part.columns, *new.columns], names=[*part.schema.names, *new.schema.names])


def emit(rows_: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows_, strict=True)) if rows_ else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


class WordHash(dict):
    """64-bit hashes of words, kept between calls up to a bound."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def carried(documents: DataFrame) -> tuple[DataFrame, int, list[Column]]:
    """(the rows under names that clash with nothing, the place of ``text``, the columns that bring the names back).

    An operator that keeps or drops whole rows sends each text through its task once, as one of the row's own columns.
    """
    names = documents.columns
    return documents.toDF(*(f"_{i}" for i in range(len(names)))), names.index("text"), [F.col(f"_{i}").alias(n) for i, n in enumerate(names)]
