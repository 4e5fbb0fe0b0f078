"""Groups in Python without a call into pandas for each: groups are dealt by key, sorted, and walked in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def by_group(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[tuple, list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``fn(key, rows)`` for each group, rows in order; a group is one page's, so it is small. Columns of a row are those
    of ``df``, keys first."""
    rest = [c for c in df.columns if c not in keys]
    rows = df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order)
    n, out = len(keys), to_arrow_schema(StructType.fromDDL(schema))

    def tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def pack(found: list[tuple]) -> pa.RecordBatch:
        cols = zip(*found) if found else [()] * len(out)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for key, group in groupby(tuples(batches), key=lambda r: r[:n]):
            found += fn(key, [r[n:] for r in group])
            if len(found) >= 5000:
                yield pack(found)
                found = []
        yield pack(found)

    return rows.mapInArrow(run, schema)
