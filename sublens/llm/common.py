"""Small helpers shared by the operators: reading, scratch tables, batches and hashing."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MIX_A, MIX_B, MIX_C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder the cluster names in spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context_dir = spark.sparkContext.getCheckpointDir()
        if context_dir:
            base = context_dir
        elif spark.sparkContext.master.startswith("local"):
            import tempfile
            base = tempfile.mkdtemp(prefix="llm-scratch-")
            spark.sparkContext.setCheckpointDir(base)
            base = spark.sparkContext.getCheckpointDir()
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet into the shared scratch folder and read back: cuts the lineage,
    and fixes values that a recomputed task would draw anew (row ids, task numbers)."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by `written`, when nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """`batch` in slices of about `most` bytes of text (one longer text makes its own slice)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes.astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs to equal, otherwise well spread, values."""
    x = (x ^ (x >> np.uint64(30))) * MIX_B
    x = (x ^ (x >> np.uint64(27))) * MIX_C
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2^64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        base, inverse = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
        for key, b in (("up", base), ("down", inverse)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums of symbol * base^position, for `span_hashes`."""
    up, _ = powers(len(symbols))
    out = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum(mix(symbols.astype(np.uint64) + MIX_A) * up, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of the symbols behind `sums`, by content and length."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * MIX_A)


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of UTF-8 texts (runs of bytes other than ASCII white space, A-Z lowered).

    Returns (bytes with a space after each text, text bounds (n+1), word starts, word ends,
    index of the first word of each text (n+1)).  Null texts are empty.
    """
    values = [x or b"" for x in column.cast(pa.binary()).to_pylist()]
    data = np.frombuffer(b" ".join([*values, b""]), dtype=np.uint8)
    if lower:
        data = LOWER[data]
    bounds = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum([len(v) + 1 for v in values], out=bounds[1:])
    inside = ~SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    return data, bounds, start, end, np.searchsorted(start, bounds)


def sums_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]] for each i; empty ranges give 0."""
    total = np.concatenate((np.zeros(1, dtype=values.dtype), np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def key_table(keys: np.ndarray, values: np.ndarray):
    """A hash table of distinct uint64 keys as arrays, for `lookup`."""
    bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 6))))
    slot_key = np.full(1 << bits, np.iinfo(np.uint64).max, dtype=np.uint64)
    slot_value = np.full(1 << bits, -1, dtype=np.int32)
    at = (keys * MIX_A) >> np.uint64(64 - bits)
    left = np.arange(len(keys))
    while len(left):  # each round the first key of each free slot takes it, the others move on
        spot, first = np.unique(at[left], return_index=True)
        free = slot_value[spot] == -1
        won = left[first[free]]
        slot_key[spot[free]], slot_value[spot[free]] = keys[won], values[won]
        left = np.setdiff1d(left, won, assume_unique=True)
        at[left] = (at[left] + np.uint64(1)) & np.uint64((1 << bits) - 1)
    return slot_key, slot_value, bits


def lookup(table, keys: np.ndarray) -> np.ndarray:
    """Values of `keys` in a `key_table`, -1 where absent."""
    slot_key, slot_value, bits = table
    at = (keys * MIX_A) >> np.uint64(64 - bits)
    out, seen = slot_value[at], slot_key[at]
    left = np.flatnonzero((seen != keys) & (out != -1))
    out[seen != keys] = -1
    while len(left):
        at_left = (at[left] + np.uint64(1)) & np.uint64((1 << bits) - 1)
        at[left] = at_left
        value, seen = slot_value[at_left], slot_key[at_left]
        hit = seen == keys[left]
        out[left[hit]] = value[hit]
        left = left[~hit & (value != -1)]
    return out
