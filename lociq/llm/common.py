"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(parts)).cast("int")


def column_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    return [b"" if x is None else x for x in column.to_pylist()]


def pieces(batch: pa.RecordBatch, sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of the batch of about ``most`` bytes each (a single longer row stands alone)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield start, batch.num_rows


class Words:
    """Maps words to numbers; the numbers of one chunk index ``names``."""

    def __init__(self) -> None:
        self.index: dict[bytes, int] = {}

    def codes(self, words: list[bytes]) -> np.ndarray:
        index = self.index
        for word in set(words):
            if word not in index:
                index[word] = len(index)
        return np.fromiter(map(index.__getitem__, words), dtype=np.int32, count=len(words))

    @property
    def names(self) -> list[bytes]:
        return list(self.index)
