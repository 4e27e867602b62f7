"""What the operators share: tables by name, staged tables, and Arrow columns."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weirflow.plans.fixpoint import settled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table once into the shared folder and read it again, so that lost executors repeat nothing before it."""
    return settled(df, name)


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one, so that none of them meets an operator's own columns."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """A string column as Python strings, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A string column as its UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


#: Text that an operator takes up at a time; a single longer text comes alone.
BATCH_BYTES = 2 << 20
#: What a worker remembers between batches, and the longest word that it remembers at all, in bytes.
MEMORY_BYTES, LONGEST_REMEMBERED = 64 << 20, 256
#: A dict's own share of an entry.
_ENTRY_BYTES = 100


class Memory:
    """Values by word, remembered between batches up to a number of bytes; beyond it the memory starts anew.

    The words of the batch at hand are held whatever their size: they are as many bytes as its text.
    """

    def __init__(self, most_bytes: int = MEMORY_BYTES) -> None:
        self.known: dict = {}
        self.most_bytes, self.bytes, self._passing = most_bytes, 0, []

    def recall(self, words: Iterable[str], learn: Callable[[list], Iterable]) -> dict:
        """A dict that has all the distinct words; learn gives the values of a list of new ones, in order."""
        if self.bytes > self.most_bytes:
            self.known.clear()
            self.bytes, self._passing = 0, []
        for word in self._passing:
            value = self.known.pop(word)
            self.bytes -= sys.getsizeof(word) + sys.getsizeof(value) + _ENTRY_BYTES
        self._passing = []
        new = [w for w in words if w not in self.known]
        if new:
            values = list(learn(new))
            self.known.update(zip(new, values))
            sizes = list(map(sys.getsizeof, new))
            if max(sizes) > LONGEST_REMEMBERED:
                self._passing = [w for w, size in zip(new, sizes) if size > LONGEST_REMEMBERED]
            self.bytes += sum(sizes) + sum(map(sys.getsizeof, values)) + _ENTRY_BYTES * len(new)
        return self.known


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = 512, most_bytes: int = BATCH_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, of so many rows and so much of the column at most, so that what a task holds at once depends on neither.

    What Arrow has freed goes back to the system batch by batch, as a worker lives on behind its task.
    """
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        if column in batch.schema.names:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = upto[start - 1] if start else 0
            end = max(start + 1, min(start + rows, int(np.searchsorted(upto, before + most_bytes, side="right"))))
            yield batch.slice(start, end - start)
            start = end
        del batch
        pa.default_memory_pool().release_unused()
