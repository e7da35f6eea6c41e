"""What several of the text operators share: words, tables, and byte-bounded batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves ``remainder``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def words_of(text: bytes) -> list[bytes]:
    """Words of one text; bytes split at exactly the six ASCII blanks."""
    return text.split()


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches so that a piece holds about ``limit`` bytes of text (or one row), with its texts as UTF-8.

    Null texts come as empty ones. Memory in a task follows the chunk, not the batch.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        sizes = np.cumsum(np.nan_to_num(pa.compute.binary_length(column).to_numpy(zero_copy_only=False).astype(float)))
        start, before = 0, 0.0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(sizes, before + limit, side="right")))
            yield batch.slice(start, stop - start), [t or b"" for t in column.slice(start, stop - start).to_pylist()]
            before, start = float(sizes[stop - 1]), stop


BROADCAST_ROWS = 200_000  # rows of ids or pairs, some 24 bytes each


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its rows, counted, are few; else as it is, for a join that shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
