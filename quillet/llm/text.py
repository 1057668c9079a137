"""Word splitting, hashing and Arrow helpers that the corpus operators share.

A word is a maximal run of characters outside \\x20 and \\x09-\\x0D, which is what bytes.split()
cuts at. Word hashes are 64-bit and the same in every process; windows of n words are combined
from them with numpy, so whole texts of any length cost a few vector operations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MULTIPLIER = 0x9E3779B97F4A7C15


class WordHashes(dict):
    """word -> 64-bit hash; forgets all at a bound, so its memory does not follow the vocabulary."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(hashes: np.ndarray, n: int, multiplier: int = _MULTIPLIER) -> np.ndarray:
    """The hash of each n consecutive words, by doubling: log2(n) vector steps."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out, covered = None, 0
    power, length = hashes, 1
    rest = n
    while rest:
        if rest & 1:
            if out is None:
                out, covered = power, length
            else:
                scale = np.uint64(pow(multiplier, length, 1 << 64))
                usable = min(len(out), len(power) - covered)
                out = out[:usable] * scale + power[covered : covered + usable]
                covered += length
        rest >>= 1
        if rest:
            scale = np.uint64(pow(multiplier, length, 1 << 64))
            power = power[: len(power) - length] * scale + power[length:]
            length *= 2
    return mix(out[: len(hashes) - n + 1])


def binary_column(batch: pa.RecordBatch | pa.Table, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with state made once per task: make() gives the function for its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return df.mapInArrow(run, schema)


def filter_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], np.ndarray]]) -> DataFrame:
    """The rows, with all their columns, for which a function of the batch (made once per task) is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(np.asarray(keep(batch), bool)))

    return df.mapInArrow(run, df.schema)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is a multiple of folds (null ids: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone: extra columns of a table, whatever they are called, play no part."""
    return df.select(*[df[name] for name in names])
