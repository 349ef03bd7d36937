"""Maps over the texts of a frame in Arrow batches: other columns pass through untouched, so ids and nulls keep their exact values."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
SPARK = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(), "binary": T.BinaryType()}
Fields = Sequence[tuple[str, str]]


def _slices(parts: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Parts of the batches, so that few texts are Python objects at a time."""
    for x in parts:
        for at in range(0, x.num_rows, rows):
            yield x.slice(at, rows)


def _schema(base: DataFrame, fields: Fields) -> T.StructType:
    return T.StructType([*base.schema.fields, *[T.StructField(n, SPARK[kind]) for n, kind in fields]])


def _batch(columns: list, names: list[str], found: Sequence, fields: Fields) -> pa.RecordBatch:
    new = [pa.array(v, TYPES[kind]) for v, (_, kind) in zip(found, fields)]
    return pa.RecordBatch.from_arrays([*columns, *new], names=[*names, *[n for n, _ in fields]])


def add_columns(df: DataFrame, text: str, of: Callable[[list], Sequence], fields: Fields) -> DataFrame:
    """``df`` with new columns: ``of`` gets a batch's values of ``text`` and returns one sequence for each field.

    Columns of ``df`` that are named like a field, other than ``text``, are replaced.
    """
    base = df.drop(*[n for n, _ in fields])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _slices(parts):
            yield _batch(x.columns, x.schema.names, of(x.column(text).to_pylist()), fields)

    return base.mapInArrow(run, _schema(base, fields))


def explode_text(df: DataFrame, text: str, of: Callable[[list], tuple[Sequence[int], Sequence]], fields: Fields) -> DataFrame:
    """Any number of rows for each row of ``df``, without ``text``: ``of`` returns the rows' places in the batch and the fields."""
    base = df.drop(text)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _slices(parts):
            places, found = of(x.column(text).to_pylist())
            at = pa.array(places, pa.int64())
            kept = [n for n in x.schema.names if n != text]
            yield _batch([x.column(n).take(at) for n in kept], kept, found, fields)

    return df.mapInArrow(run, _schema(base, fields))


def map_rows(df: DataFrame, of: Callable[..., Sequence], fields: Fields) -> DataFrame:
    """The first column of ``df`` with one value for each field: ``of`` gets a row's values and returns the fields'."""
    key = df.columns[0]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _slices(parts):
            found = [of(*values) for values in zip(*(x.column(n).to_pylist() for n in x.schema.names))]
            yield _batch([x.column(key)], [key], list(zip(*found)) if found else [[] for _ in fields], fields)

    return df.mapInArrow(run, _schema(df.select(key), fields))
