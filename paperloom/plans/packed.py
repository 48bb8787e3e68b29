"""Rows of each key brought together by one move of packed rows.

A task sorts a few MB of rows by the task they go to and sends each lot as one
compressed value, columns apart, so ids and texts move in a part of the bytes
that they take as rows. Functions of this module travel to the executors by value.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PACK = 1 << 25  # bytes of rows that are packed together
KEYS = 1 << 13  # keys of a batch that is given on


def _written(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _read(lot: bytes, fields: list[int] | None = None) -> pa.Table:
    return pa.ipc.open_stream(lot, options=pa.ipc.IpcReadOptions(included_fields=fields)).read_all().combine_chunks()


def _lots(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    goes = table["lot"].to_numpy()
    order = np.argsort(goes, kind="stable")
    rows = table.drop_columns(["lot"]).take(order).combine_chunks()
    lots, first = np.unique(goes[order], return_index=True)
    packed = [_written(rows.slice(a, b - a)) for a, b in zip(first, [*first[1:], len(order)])]
    return pa.RecordBatch.from_arrays([pa.array(lots, pa.int32()), pa.array(packed, pa.binary())], ["lot", "rows"])


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lot, rows) from rows with the number of their lot in `lot`."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= PACK:
            yield _lots(held)
            held, size = [], 0
    if sum(map(len, held)):
        yield _lots(held)


def _nested(rows: pa.Table, offsets: np.ndarray) -> pa.RecordBatch:
    """(key, rows) of rows in the order of their keys, the first column; each key's rows begin at its offset."""
    columns = [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in rows.columns]
    structs = pa.StructArray.from_arrays(columns[1:], names=rows.column_names[1:])
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)
    return pa.RecordBatch.from_arrays([columns[0].take(pa.array(offsets[:-1])), lists], [rows.column_names[0], "rows"])


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rows) of all lots of a task: they are held packed, and rows of keys that come again are put together."""
    lots = [lot for batch in batches for lot in batch.column("rows").to_pylist()]
    if not lots:
        return
    keys = pa.chunked_array([c for lot in lots for c in _read(lot, [0]).column(0).chunks]).combine_chunks()
    keys = (keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys).dictionary_encode()
    codes = keys.indices.fill_null(-1).to_numpy()
    times = np.bincount(codes + 1, minlength=1)
    times[0] = 0
    again = times[codes + 1] > 1
    del keys, times
    at, held, held_codes = 0, [], []
    for lot in lots:
        rows = _read(lot)
        more = again[at:at + len(rows)]
        if more.any():
            held.append(rows.filter(pa.array(more)))
            held_codes.append(codes[at:at + len(rows)][more])
            at += len(rows)
            rows = rows.filter(pa.array(~more)).combine_chunks()
        else:
            at += len(rows)
        for start in range(0, len(rows), KEYS):
            part = rows.slice(start, KEYS).combine_chunks()
            yield _nested(part, np.arange(len(part) + 1))
    if held:
        code = np.concatenate(held_codes)
        order = np.argsort(code, kind="stable")
        rows, first = pa.concat_tables(held).take(order).combine_chunks(), np.unique(code[order], return_index=True)[1]
        ends = np.append(first, len(order))
        for start in range(0, len(first), KEYS):
            offsets = ends[start:start + KEYS + 1]
            yield _nested(rows.slice(offsets[0], offsets[-1] - offsets[0]).combine_chunks(), offsets - offsets[0])


def gathered(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """(key, rows): all rows of each key as an array of structs of the other columns; a row without a key stands alone."""
    rest = [c for c in df.columns if c != key]
    goes = F.pmod(F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(*rest)), F.lit(tasks)).cast("int")
    lots = df.select(key, *rest, goes.alias("lot")).mapInArrow(pack, "lot int, rows binary").repartitionById(tasks, "lot")
    kept = [df.schema[c] for c in rest]
    schema = T.StructType([df.schema[key], T.StructField("rows", T.ArrayType(T.StructType(kept)))])
    return lots.mapInArrow(unpack, schema)
