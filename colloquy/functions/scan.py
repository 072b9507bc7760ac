"""Ordered scans: what needs the rows of a key in order, in constant memory.

A scan shuffles once by its keys, sorts within partitions, and hands every key's rows to a generator
as a stream. Nothing is collected: state is what the generator keeps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

Rows = Iterator[dict]


def ordered_scan(df: DataFrame, keys: list[str], order: list[str | Column], scan: Callable[[Rows], Iterator[tuple]], schema: str | StructType, batch: int = 4096, parts: int | None = None) -> DataFrame:
    """scan(rows of one key in order) yields tuples of schema. Keys compare null-safely; an empty table gives none.
    parts: tasks to deal the keys over, where each is long work; else as Spark sees fit."""
    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    # a recording is named by whatever type the rows name it
    kind = StructType([df.schema[f.name] if f.name == "rec" and "rec" in df.columns else f for f in kind])
    arrow = to_arrow_schema(kind)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for frame in frames for row in frame.to_pylist())
        out = (made for _, group in groupby(rows, key=lambda r: tuple(r[k] for k in keys)) for made in scan(group))
        while chunk := list(islice(out, batch)):
            columns = zip(*chunk, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.repartition(*([parts] if parts else []), *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, kind)
