"""Vectors as bytes and back: little-endian 32-bit floats, read off Arrow's buffers batch by batch."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def _one(x: pa.Array | pa.ChunkedArray) -> pa.Array:
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


@F.arrow_udf(BinaryType())
def _bytes(x: pa.Array) -> pa.Array:
    # the list's numbers are the bytes: four for each, from where a row begins to where it ends
    x = _one(x)
    x = pa.concat_arrays([x]) if x.offset else x
    at = pc.multiply(x.offsets.cast(pa.int64()), 4).cast(pa.int32())
    holed = pc.is_in(pa.array(range(len(x)), pa.int64()), pc.unique(pc.filter(pc.list_parent_indices(x), pc.is_null(x.flatten())).cast(pa.int64()))) if x.flatten().null_count else None
    out = pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, at.buffers()[1], x.values.buffers()[1]], 0)
    gone = x.is_null() if holed is None else pc.or_(x.is_null(), holed)
    return pc.if_else(gone, pa.scalar(None, pa.binary()), out)


@F.arrow_udf(ArrayType(FloatType()))
def _floats(x: pa.Array) -> pa.Array:
    x = _one(x)
    joined = pa.concat_arrays([x, pa.array([b""], x.type)])  # a copy without offset; the last item keeps its buffers there
    offsets = pa.Array.from_buffers(pa.int32(), len(x) + 1, [None, joined.buffers()[1]])
    values = pa.Array.from_buffers(pa.float32(), offsets[-1].as_py() // 4, [None, joined.buffers()[2]])
    return pa.ListArray.from_arrays(pc.divide(offsets, 4), values, mask=x.is_null())


def to_bytes(vector: Column) -> Column:
    """A vector as bytes; null for a null vector or one with a null component. An empty vector is no bytes."""
    return _bytes(vector.cast("array<float>"))


def byte_state(held: Column, dim: int | None = None) -> Column:
    """`empty` (null or no bytes), `torn` (no multiple of four), `dimension` (not `dim` numbers) or `ok`."""
    n = F.octet_length(held)
    other = F.lit(False) if dim is None else n != 4 * dim
    return F.when(held.isNull() | (n == 0), "empty").when(n % 4 != 0, "torn").when(other, "dimension").otherwise("ok")


def from_bytes(held: Column, dim: int | None = None) -> Column:
    """The vector of such bytes; null where byte_state isn't ok."""
    # what isn't ok becomes no bytes before it is read, as rows share their buffers
    good = byte_state(held, dim) == "ok"
    return F.when(good, _floats(F.when(good, held)))
