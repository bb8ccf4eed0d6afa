"""User functions over texts: pairs of them, and whole Arrow batches with a reader and a builder of UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, _parse_datatype_string


def apply_binary_str(a: Column, b: Column, *, func: Callable[[bytes, int, bytes, int], object], output_dtype: str | DataType) -> Column:
    """``func(bytes_a, length_a, bytes_b, length_b)`` for each pair, null if either text is.

    Rows cross to Python as Arrow batches; the texts are handed over as views of their UTF-8 bytes.
    """
    if not callable(func):
        raise ValueError("func must be callable")
    try:
        kind = output_dtype if isinstance(output_dtype, DataType) else _parse_datatype_string(output_dtype)
        arrow = to_arrow_type(kind)
    except Exception as e:
        raise ValueError(f"not a type: {output_dtype!r}") from e

    @arrow_udf(kind)
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        pairs = zip(x.cast(pa.binary()).to_pylist(), y.cast(pa.binary()).to_pylist(), strict=True)
        return pa.array([None if p is None or q is None else func(p, len(p), q, len(q)) for p, q in pairs], arrow)

    return run(a, b)


class Utf8Reader:
    """The texts of one Arrow array, read in place: nothing is copied before it is asked for."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        self.texts = texts.cast(pa.large_binary())
        _, offsets, data = self.texts.buffers()
        self.ends = np.frombuffer(offsets, dtype=np.int64)[self.texts.offset : self.texts.offset + len(texts) + 1] if offsets is not None else np.zeros(1, dtype=np.int64)
        self.data = memoryview(data) if data is not None else memoryview(b"")

    def __len__(self) -> int:
        return len(self.texts)

    def is_null(self, i: int) -> bool:
        return not self.texts[i].is_valid

    def view(self, i: int) -> memoryview:
        """The bytes of text ``i``."""
        return self.data[self.ends[i] : self.ends[i + 1]]

    def byte_length(self, i: int) -> int:
        return int(self.ends[i + 1] - self.ends[i])

    def total_bytes(self) -> int:
        return int(self.ends[-1] - self.ends[0])

    def text(self, i: int) -> str:
        return str(self.view(i), "utf-8")


class Utf8Builder:
    """A text column put together byte by byte or piece by piece."""

    def __init__(self):
        self.data, self.ends, self.valid = bytearray(), [0], []

    def put(self, piece: int | bytes | bytearray | memoryview) -> None:
        """One byte, or several."""
        if isinstance(piece, int):
            self.data.append(piece)
        else:
            self.data += piece

    def end_text(self) -> None:
        self.ends.append(len(self.data))
        self.valid.append(True)

    def end_null(self) -> None:
        """A null; what was put since the last end is dropped."""
        del self.data[self.ends[-1] :]
        self.ends.append(len(self.data))
        self.valid.append(False)

    def build(self) -> pa.Array:
        """The column; bytes that are not UTF-8 are an error."""
        known = pa.array(self.valid, pa.bool_())
        offsets = pa.py_buffer(np.array(self.ends, dtype=np.int64))
        made = pa.Array.from_buffers(pa.large_string(), len(self.valid), [known.buffers()[1] if self.valid else None, offsets, pa.py_buffer(bytes(self.data))])
        made.validate(full=True)
        return made.cast(pa.string())


def apply_utf8(*columns: Column, func: Callable[..., None]) -> Column:
    """A text column that ``func`` writes: it is called once for each Arrow batch, with a reader for each column and a builder, and ends
    as many texts (or nulls) as the batch has rows.
    """

    @arrow_udf("string")
    def run(*arrays: pa.Array) -> pa.Array:
        out = Utf8Builder()
        func(*[Utf8Reader(a) for a in arrays], out)
        if len(out.valid) != len(arrays[0]):
            raise ValueError(f"{len(out.valid)} texts for {len(arrays[0])} rows")
        return out.build()

    return run(*columns)
