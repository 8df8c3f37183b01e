"""What the text operators share: adding Arrow-computed columns, and words of a text as bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_FOLD = bytes.maketrans(_UPPER, _LOWER)
_SPACES = bytes([32, 9, 10, 11, 12, 13])


def byte_table(separators: bytes) -> bytes:
    """A translation table that lower-cases A-Z and turns ``separators`` into blanks."""
    table = bytearray(_FOLD)
    for code in separators:
        table[code] = 32
    return bytes(table)


SPACE_TABLE = byte_table(_SPACES)
#: Everything in ASCII but digits and letters separates; bytes from 0x80 on belong to words.
WORD_TABLE = byte_table(bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122)))


def byte_words(text: str | None, table: bytes) -> list[bytes]:
    """Words of ``text`` as UTF-8 bytes, separated by what ``table`` turns into blanks.

    ``bytes.split()`` without an argument would also split at other control bytes, so the
    blank is named and the empty pieces between two blanks are left out.
    """
    if not text:
        return []
    return [w for w in text.encode("utf-8", "surrogatepass").translate(table).split(b" ") if w]


def add_columns(df: DataFrame, inputs: list[str], outputs: str,
                make: Callable[[list[pa.Array]], list[pa.Array]]) -> DataFrame:
    """``df`` with columns computed batch by batch; nothing is shuffled.

    ``outputs`` is a DDL string. An input column of an output's name gives way to it after
    it has been read; all others pass through untouched, whatever they are called.
    """
    fields = T.StructType.fromDDL(outputs).fields
    new = {f.name.lower() for f in fields}
    kept = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in new]
    at = [df.columns.index(name) for name in inputs]
    schema = T.StructType([df.schema.fields[i] for i in kept] + fields)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make([batch.column(i) for i in at])
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + made, names=names)

    return df.mapInArrow(run, schema)


def values(column: pa.Array) -> Iterator:
    """Python values one at a time, so that only one long text is decoded at once."""
    return (x.as_py() for x in column)
