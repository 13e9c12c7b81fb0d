"""Packed numpy columns in binary Arrow cells, for shuffles that move arrays instead of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def binary_cells(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """One binary cell for each run of `values` between neighbouring `cuts`."""
    values = np.ascontiguousarray(values)
    offsets = np.asarray(cuts, np.int64) * values.dtype.itemsize
    if len(offsets) and offsets[-1] > np.iinfo(np.int32).max:
        raise OverflowError("more than 2 GiB in the cells of one batch")
    offsets = offsets.astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def joined(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """The values of all cells of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Where the first of equal neighbours stands, with any number of parallel keys."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


BUCKET_SCHEMA = "bucket long, ids binary, keys binary, lengths binary"


def by_bucket(bucket: np.ndarray, ids: np.ndarray, keys: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket; documents (id, key) are run-length coded, other columns packed."""
    order = np.argsort(bucket, kind="stable")
    bucket, ids, keys = bucket[order], ids[order], keys[order]
    runs = run_starts(bucket, ids, keys)
    heads = run_starts(bucket)
    cuts = np.append(heads, len(bucket))
    run_cuts = np.searchsorted(runs, cuts)
    lengths = np.diff(np.append(runs, len(bucket))).astype(np.uint32)
    arrays = [pa.array(bucket[heads].astype(np.int64)), binary_cells(ids[runs], run_cuts), binary_cells(keys[runs], run_cuts), binary_cells(lengths, run_cuts)]
    arrays += [binary_cells(v[order], cuts) for v in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "ids", "keys", "lengths", *columns])


def documents_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Document id and key of each packed entry of a bucket."""
    lengths = joined(table["lengths"], np.uint32)
    return np.repeat(joined(table["ids"], np.int64), lengths), np.repeat(joined(table["keys"], np.int64), lengths)


def by_document(ids: np.ndarray, keys: np.ndarray, name: str, values: np.ndarray) -> pa.RecordBatch:
    """A row (id, key, packed values) for each document."""
    order = np.lexsort((keys, ids))
    ids, keys, values = ids[order], keys[order], values[order]
    heads = run_starts(ids, keys)
    cuts = np.append(heads, len(ids)) if len(ids) else np.zeros(1, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ids[heads]), pa.array(keys[heads]), binary_cells(values, cuts)], ["id", "key", name])
