"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import weakref
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes in one Arrow batch; a batch holds whole texts, so rows alone don't bound it.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small enough for an executor's Python memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, object]], schema: str) -> DataFrame:
    """``mapInArrow`` over plain column lists: ``fn`` gets and returns ``{column: values}``."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        give_back()

    return df.mapInArrow(run, schema)


def gathered(batches: Iterable[pa.RecordBatch], size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold about ``size`` bytes, for work whose cost falls with the batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def give_back() -> None:
    """Returns memory that a finished task has freed to the system; workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # a C library without it keeps what it has
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: The memories of this process.
_MEMOS: list[weakref.ref] = []


def forget() -> None:
    """Empties every memory of this worker, for stages that need the room and none of the words kept for others."""
    for memo in [m() for m in _MEMOS]:
        if memo is not None:
            memo.clear()
            memo.old = {}
    give_back()


class Memo(dict):
    """Bounded memory of computed values for one Python worker, in two generations.

    When the young one is full it becomes the old one; a value met again moves back to the young
    one, so frequent keys stay while rare ones go.
    """

    def __init__(self, entries: int, longest_key: int, make: Callable[[str], object] | None = None):
        self.entries, self.longest_key, self.make, self.old = entries, longest_key, make, {}
        _MEMOS[:] = [m for m in _MEMOS if m() is not None] + [weakref.ref(self)]

    def __missing__(self, key: str) -> object:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.keep(key, value)
        return value

    def keep(self, key: str, value: object) -> None:
        if len(key) <= self.longest_key:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value

    def fill(self, keys: Iterable[str], make: Callable[[list[str]], list]) -> None:
        """Learns all ``keys`` that are not young yet; ``make`` gets those that are in neither generation at once."""
        old, new = self.old, []
        for key in [k for k in keys if k not in self]:
            if key in old:
                self.keep(key, old[key])
            elif len(key) <= self.longest_key:
                new.append(key)
        if new:
            for key, value in zip(new, make(new)):
                self.keep(key, value)
