"""Helpers that work on the byte buffers of Arrow string columns, without a Python object per word."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy kernels take at once; a longer document is taken alone.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch at most: they hold whole texts, or packed rows of some 10 KB.
BATCH_ROWS = 2000

_P = np.uint64(0x9E3779B97F4A7C15 | 5)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_BYTE_CODES, _MORE_CODES = (np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1) for seed in (20240229, 20250601))

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of rows in an Arrow batch to BATCH_ROWS; both the JVM and Python hold a few batches for each core."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def text_column(name: str = "text"):
    """The column as text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def map_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], Iterable[dict | pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a kernel that gives dicts of columns (or batches) for a batch of rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in kernel(batch):
                if isinstance(out, dict):
                    out = pa.RecordBatch.from_arrays([as_array(out[f.name], f.type) for f in target], schema=target)
                yield out

    return df.mapInArrow(run, schema)


def units_for(spark: SparkSession, size: int, target: int) -> int:
    """A multiple of the shuffle partitions, so many that a unit has about target of size."""
    parts = shuffle_partitions(spark)
    return parts * max(1, -(-size // (target * parts)))


def unit_of(h: np.ndarray, units: int) -> np.ndarray:
    """The unit of each 64-bit hash, by its upper half."""
    return ((h >> np.uint64(32)) * np.uint64(units) >> np.uint64(32)).astype(np.int64)


def by_unit(df: DataFrame, unit: str, kernel: Callable[[int, list[tuple]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Runs kernel(unit, rows) for each unit, a number from 0 in the column of that name, with all its rows.

    Units are dealt evenly, to the partition of their number modulo the partitions, and sorted there (Spark's sort
    spills), so that a task holds the rows of one unit at a time.
    """
    small_batches(df.sparkSession)
    parts = shuffle_partitions(df.sparkSession)
    at = df.columns.index(unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[at] != group[0][at]:
                    yield from kernel(group[0][at], group)
                    group = []
                group.append(row)
        if group:
            yield from kernel(group[0][at], group)

    dealt = df.repartitionById(parts, F.pmod(F.col(unit), F.lit(parts)).cast("int"))
    return dealt.sortWithinPartitions(unit).mapInArrow(run, schema)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    if isinstance(values, np.ndarray) and values.dtype != object:
        return pa.array(values).cast(kind)
    return pa.array(values, kind)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls; offsets start at 0."""
    kind = column.type
    width = np.int64 if pa.types.is_large_string(kind) or pa.types.is_large_binary(kind) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about limit bytes."""
    raw, offsets = text_buffers(column)
    row, rows = 0, len(column)
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(rows, max(row + 1, end))
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P), np.full(n, _P_INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(SLICE_BYTES + 2 if n <= SLICE_BYTES + 2 else 1 << int(n).bit_length())


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def prefix_sums(raw: np.ndarray, again: bool = False) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64; entry i covers raw[:i]. again: with other codes for the bytes, for a second 64 bits."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.multiply((_MORE_CODES if again else _BYTE_CODES)[raw], powers(len(raw) + 1)[0][: len(raw)], out=sums[1:])
    np.add.accumulate(sums, out=sums)
    return sums


def segment_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end], the same wherever the bytes stand."""
    down = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of maximal runs of bytes that aren't ASCII white space; no run crosses a document's border."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~IS_SPACE[raw]
    fresh = np.ones(len(raw) + 1, bool)
    fresh[1:-1] = False
    fresh[offsets] = True
    before = np.zeros(len(raw), bool)
    before[1:] = solid[:-1]
    after = np.zeros(len(raw), bool)
    after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | fresh[:-1]))
    ends = np.flatnonzero(solid & (~after | fresh[1:])) + 1
    return starts, ends


def per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a byte-wise array for each document."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeated(group: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether (group, key) stands twice or more, and whether it stood before."""
    n = len(keys)
    twice, later = np.zeros(n, bool), np.zeros(n, bool)
    if n < 2:
        return twice, later
    keyed = mix(keys ^ mix(group.astype(np.uint64) + np.uint64(0x51ED27)))
    order = np.argsort(keyed, kind="stable")
    same = (keyed[order[1:]] == keyed[order[:-1]]) & (group[order[1:]] == group[order[:-1]])
    later[order[1:]] = same
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice, later
