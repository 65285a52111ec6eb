"""What the corpus operators share: saved tables, bounded batches, tokenising."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import ONE_TASK, discard, free_name, prefix_sums, saved  # noqa: F401



#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that a Python worker takes apart at a time.
SLICE_BYTES = 4 << 20

_BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of rows with about `most` bytes of `column`; a longer text stands alone and whole."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        run = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = run[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(run, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def word_spans(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, those of SLICE_BYTES at a time."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, min(at + SLICE_BYTES, len(text)))
        stop = blank.start() if blank else len(text)
        yield text[at:stop].split()
        at = stop


def output(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; of null, that of an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(m))


def sampled(rows: DataFrame, most: int, *key: Column) -> DataFrame:
    """About `most` rows, or all if there are no more: those whose hash of `key` lies under a bound that follows from the count of rows.

    Rows are picked where they lie, so what a later `limit` sends to the driver doesn't grow with the number of tasks. The bound
    leaves six standard deviations above `most`. Rows alike in `key` are picked together. Empty table: empty.
    """
    n = rows.count()
    share = min(1.0, (most + 6 * most**0.5 + 20) / n) if n else 1.0
    return rows if share == 1.0 else rows.filter(F.pmod(F.xxhash64(*key), F.lit(1 << 40)) < int(share * (1 << 40)))
