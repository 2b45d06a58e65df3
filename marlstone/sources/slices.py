"""Python stages over whole texts that hold a slice of a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that are turned into Python objects at once; Spark's batches of texts hold up to ten thousand.
ROWS = 128


def map_slices(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """``mapInArrow`` over plain column lists of ``ROWS`` rows: ``fn`` gets and returns ``{column: values}``.

    A worker holds one batch as Spark sends it, whose bytes Spark bounds, and the objects of one slice;
    what a slice gives is handed on before the next one is read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, len(b), ROWS):
                piece = b.slice(start, ROWS)
                out = fn({name: piece.column(i).to_pylist() for i, name in enumerate(b.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
