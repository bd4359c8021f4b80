"""Files whose bytes are made from smaller rows, in the worker and at the moment that reads them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType

Batches = Iterator[pa.RecordBatch]


@dataclass(frozen=True)
class Made:
    """rows: what files are made from. make: batches of rows to batches of the columns of schema."""

    rows: DataFrame
    make: Callable[[Batches], Batches]
    schema: StructType

    def where(self, condition: Column | str) -> Made:
        """By columns of the rows."""
        return replace(self, rows=self.rows.where(condition))

    def frame(self) -> DataFrame:
        return self.rows.mapInArrow(self.make, self.schema)

    def select(self, *columns: str | Column) -> DataFrame:
        return self.frame().select(*columns)


def over(files: DataFrame | Made, columns: list[str], run: Callable[[Batches], Batches], schema: StructType | str) -> DataFrame:
    """`run` over these columns of the files. Bytes that are made go straight to it, and to no other process."""
    if not isinstance(files, Made):
        return files.select(*[files[c].alias(f"_{i}") for i, c in enumerate(columns)]).mapInArrow(run, schema)
    make, names = files.make, files.schema.names
    places = [names.index(c) for c in columns]

    def both(batches: Batches) -> Batches:
        yield from run(pa.RecordBatch.from_arrays([b.column(i) for i in places], names=[f"_{i}" for i in range(len(places))]) for b in make(batches))

    return files.rows.mapInArrow(both, schema)
