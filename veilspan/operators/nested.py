"""String leaves of nested values: of typed columns by their schema, of JSON text by its own shape."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.sources.batches import sliced


def map_strings(column: Column, kind: T.DataType, change: Callable[[Column], Column]) -> Column:
    """``change`` on every string inside a struct, array or map; map keys, numbers, flags and nulls stay."""
    if isinstance(kind, T.StringType):
        return change(column)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: map_strings(x, kind.elementType, change))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, v: map_strings(v, kind.valueType, change))
    if isinstance(kind, T.StructType):
        parts = [map_strings(column[f.name], f.dataType, change).alias(f.name) for f in kind.fields]
        return F.when(column.isNotNull(), F.struct(*parts))
    return column


def changed(value: object, change: Callable[[str], str]) -> object:
    """``change`` on every string leaf of a decoded JSON value; keys stay."""
    if isinstance(value, str):
        return change(value)
    if isinstance(value, list):
        return [changed(v, change) for v in value]
    if isinstance(value, dict):
        return {k: changed(v, change) for k, v in value.items()}
    return value


def leaves_of(value: object, path: str = "$") -> Iterator[tuple[str, str]]:
    """(path, string) of the string leaves."""
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from leaves_of(v, f"{path}[{i}]")
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from leaves_of(v, f"{path}.{k}")


def json_leaves(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``key``, ``path``, ``text`` of the string leaves of a JSON column; broken JSON and null have none."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            at, paths, texts = [], [], []
            for i, raw in enumerate(b.column(1).to_pylist()):
                try:
                    value = json.loads(raw, strict=False) if raw else None
                except ValueError:
                    continue
                for path, text in leaves_of(value):
                    at.append(i)
                    paths.append(path)
                    texts.append(text)
            yield pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=[key, "path", "text"])

    return rows.select(key, column).mapInArrow(run, f"`{key}` {kind}, path string, text string")
