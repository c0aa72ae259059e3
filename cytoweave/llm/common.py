"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

# bytes of text that one step inside a task looks at together
CHUNK_BYTES = 8 << 20


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    """A given table; the package is sent to the Python workers first."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every value; null counts as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def rewritten(column: pa.Array, table: bytes) -> pa.Array:
    """Large binary column with A-Z lowered and then every byte replaced by ``table``; null becomes empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = b"" if held is None else held.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes().lower().translate(table)
    return pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(data)])


def mixed(values: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit values (a fixed bijection)."""
    with np.errstate(over="ignore"):
        v = values.astype(np.uint64)
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return v ^ (v >> np.uint64(31))


def slices(batch: pa.RecordBatch, text_col: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most ``limit`` bytes of text, or a single row."""
    column = batch.column(batch.schema.get_field_index(text_col))
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_text(df: DataFrame, text_col: str, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over parts of bounded text size."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                yield from fn(part)

    return df.mapInArrow(run, schema)


def record_batch(schema: str, columns: list) -> pa.RecordBatch:
    """Record batch for a DDL schema of plain types."""
    names, types = zip(*(field.strip().split(" ", 1) for field in schema.split(", ")))
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, kinds[t]) for c, t in zip(columns, types)]
    return pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], names=list(names))


def list_array(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List column from flat values and the length of every list."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All integers of the ranges ``[start, start + count)``, one after the other."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table that is small by construction; more than ``limit`` is an error, not a cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not use yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def held_out(doc_id: Column | str) -> Column:
    """The fixed test fold: ``crc32(doc_id as text) mod 4 = 2`` (null ids are not in it)."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
