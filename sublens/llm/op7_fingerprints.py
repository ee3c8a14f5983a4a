"""Operator 7, document fingerprints by locally consistent parsing.

A text is a sequence of symbols (code points at first).  Runs of one symbol become one symbol;
deterministic coin tossing then gives each symbol a small label that depends on a few symbols
to its left only, neighbours having different labels.  Phrases begin at the local maxima of the
labels and are named by a hash of their content, which makes the sequence of the next level.
Equal substrings so get equal phrases but for a few at their borders, wherever they stand.  A
fingerprint keeps the smallest hashes of the names of level 2 (about a dozen characters each),
and of level 1 too where a text has few; likeness estimates the share of common names.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType

from sublens.llm.common import MIX_A, mix, prefix_sums, span_hashes, text_slices
from sublens.llm.pretokens import code_points

SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
KEPT = 64  # hashes of a level
FEW = 16  # texts with fewer level-2 names keep level 1 too


@cache
def _tables():
    symbols = mix(np.arange(0x110000, dtype=np.uint64) + MIX_A)
    lowest = np.zeros(1 << 16, dtype=np.uint8)
    x = np.arange(1, 1 << 16)
    lowest[1:] = np.round(np.log2(x & -x)).astype(np.uint8)
    lowest[0] = 16
    return symbols, lowest


def _labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 8 after three rounds of coin tossing, each on the labels of the one before:
    twice the place of the lowest bit that differs from the left neighbour's, plus that bit."""
    _, lowest = _tables()
    labels = symbols.astype(np.uint16)
    for _ in range(3):
        place = np.zeros(len(labels), dtype=np.uint8)
        place[1:] = lowest[labels[1:] ^ labels[:-1]]
        place[first] = 0
        labels = ((place << np.uint8(1)) | ((labels >> place.astype(labels.dtype)) & labels.dtype.type(1)).astype(np.uint8)).astype(np.uint8)
    return labels


def _phrases(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of each sequence (all non-empty, beginning at `first`), and their beginnings."""
    n = len(symbols)
    begins = np.zeros(n, dtype=bool)
    begins[first] = True
    new = begins.copy()
    new[1:] |= symbols[1:] != symbols[:-1]
    run = np.flatnonzero(new)
    length = np.diff(np.append(run, n))
    symbols = symbols[run]
    repeated = length > 1
    symbols[repeated] = mix(symbols[repeated] + length[repeated].astype(np.uint64) * MIX_A)
    begins = begins[run]
    labels = _labels(symbols, np.flatnonzero(begins)).astype(np.int8)
    left, right = np.append(np.int8(-1), labels[:-1]), np.append(labels[1:], np.int8(-1))
    right[np.append(begins[1:], True)] = -1
    start = np.flatnonzero(begins | (labels > left) & (labels > right))
    names = span_hashes(prefix_sums(symbols), start, np.append(start[1:], len(symbols)))
    return names, np.flatnonzero(begins[start])


def sketches(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """Of each text the smallest hashes of its level-2 names, and of its level-1 names if the
    former are few (else None)."""
    empty = np.zeros(0, dtype=np.uint32)
    out: list = [(empty, empty)] * len(texts)
    some = [i for i, t in enumerate(texts) if t]
    if not some:
        return out
    symbols = _tables()[0][code_points("".join([texts[i] for i in some]))]
    sizes = [len(texts[i]) for i in some]
    first = np.cumsum(sizes) - sizes
    kept = []
    for _ in range(2):
        symbols, first = _phrases(symbols, first)
        owner = np.repeat(np.arange(len(some), dtype=np.uint64), np.diff(np.append(first, len(symbols))))
        keys = np.sort(owner << np.uint64(32) | mix(symbols) >> np.uint64(32))
        keys = keys[np.append(True, keys[1:] != keys[:-1])]
        bounds = np.searchsorted(keys, np.arange(len(some) + 1, dtype=np.uint64) << np.uint64(32)).tolist()
        low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        kept.append([(low[a:min(b, a + KEPT)], b - a) for a, b in zip(bounds, bounds[1:])])
    for i, one, two in zip(some, *kept):
        out[i] = (two[0], one[0] if two[1] < FEW else None)
    return out


def shown(sketch: tuple[np.ndarray, np.ndarray | None]) -> str:
    """The fingerprint as text: hexadecimal hashes of level 2, then those of level 1 after a dot."""
    two, one = (None if x is None else x.astype(">u4").tobytes().hex() for x in sketch)
    return two if one is None else f"{two}.{one}"


def parsed(fingerprint: str) -> tuple[np.ndarray, np.ndarray | None]:
    two, dot, one = fingerprint.partition(".")
    read = lambda x: np.frombuffer(bytes.fromhex(x), dtype=">u4").astype(np.uint32)
    return read(two), read(one) if dot else None


def likeness(pairs: list[tuple]) -> np.ndarray:
    """For each pair of sketches the estimated share of names that both have, among all names of
    either: on level 1 where both keep it, else on level 2.  Two empty texts are alike (1)."""
    if not pairs:
        return np.zeros(0)
    sides = [(a[1], b[1]) if a[1] is not None and b[1] is not None else (a[0], b[0]) for a, b in pairs]
    parts = [x for pair in sides for x in pair]
    sizes = [len(x) for x in parts]
    owner = np.repeat(np.arange(len(parts), dtype=np.uint64) // np.uint64(2), sizes)
    keys = np.sort(owner << np.uint64(32) | np.concatenate(parts).astype(np.uint64))
    new = np.append(True, keys[1:] != keys[:-1])[:len(keys)]
    place = np.cumsum(new) - 1  # of the distinct names
    distinct = keys[new]
    both = np.bincount(place, minlength=len(distinct)) == 2
    bounds = np.searchsorted(distinct, np.arange(len(pairs) + 1, dtype=np.uint64) << np.uint64(32))
    full = [len(a) == KEPT or len(b) == KEPT for a, b in sides]
    end = np.where(full, np.minimum(bounds[1:], bounds[:-1] + KEPT), bounds[1:])
    common = np.concatenate(([0], np.cumsum(both)))
    n = end - bounds[:-1]
    return np.where(n == 0, 1.0, (common[end] - common[bounds[:-1]]) / np.maximum(n, 1))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the fingerprint of every row's whole text (a null text is empty)."""
    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, most=400_000):
                found = [shown(s) for s in sketches([t or "" for t in batch.column("text").to_pylist()])]
                yield pa.record_batch([batch.column("doc_id"), pa.array(found)], names=["doc_id", "fingerprint"])
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, fingerprint string")


def _compared(texts: list[str], following: list[str]) -> list:
    """Columns after doc_id of SCHEMA for texts and the texts that follow them."""
    cut = [len(t) // 2 for t in texts]
    edited = [t[:len(t) - k] + f[:k] for t, f, k in zip(texts, following, cut)]
    own = sketches([*texts, following[-1]])  # texts follow one another: each is the one before's follower
    changed = sketches(edited)
    return [pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
            pa.array([shown(s) for s in own[:-1]]), pa.array([shown(s) for s in changed]),
            pa.array(likeness(list(zip(own[:-1], changed)))), pa.array(likeness(list(zip(own[:-1], own[1:]))))]


def _range_of(splits: list[float]):
    """The range of ids a row is in, counted in descending order of ids; null ids come last."""
    @F.pandas_udf(IntegerType())
    def at(ids: pd.Series) -> pd.Series:
        place = len(splits) - np.searchsorted(splits, ids.to_numpy(dtype=np.float64, na_value=-np.inf), side="right")
        return pd.Series(place.astype(np.int32))
    return at


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint beside those of its edited text and of the next document's.

    The next document is that of the next smaller id (after the last, the first); rows that share
    an id follow one another by a hash of the text, null ids come last.  The edited text is the
    whole text with its last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document's.  A null text is empty; other columns are ignored; an empty table
    gives an empty result, a single row is its own next.

    Texts are shuffled once, into ranges of ids.  What follows the last row of a range is the
    first of the next range; these rows, one for each range, are sent along to the range before.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splits = sorted(set(rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n)))  # one number for each range
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("range", _range_of(splits)(F.col("doc_id")))
    order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "tie")
    leaders = rows.groupBy("range").agg(F.max(order).alias("top")).orderBy("range").collect()  # one row for each range
    if not leaders:
        return spark.createDataFrame([], SCHEMA)
    before = spark.createDataFrame([(r["range"], r.top.doc_id, r.top.tie, leaders[i - 1]["range"]) for i, r in enumerate(leaders)], "range int, top_id bigint, tie bigint, before int")
    first = rows.join(F.broadcast(before), ["range", "tie"]).where(F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("top_id"))
    ends = first.groupBy("before").agg(F.first("text").alias("text")).select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("tie"), F.col("before").alias("range"), F.lit(True).alias("end"))
    dealt = rows.withColumn("end", F.lit(False)).unionByName(ends).repartition(n, "range")
    dealt = dealt.sortWithinPartitions("range", "end", F.col("doc_id").desc_nulls_last(), F.col("tie").desc(), "text")

    def run(batches):
        ids, texts, ends = [], [], []  # the last row so far waits for the one after it
        for whole in batches:
            for batch in text_slices(whole, most=400_000):
                ids += batch.column("doc_id").to_pylist()
                texts += batch.column("text").to_pylist()
                ends += batch.column("end").to_pylist()
                if len(ids) > 1:
                    keep = pa.array([not e for e in ends[:-1]])
                    columns = _compared(texts[:-1], texts[1:])
                    out = pa.RecordBatch.from_arrays([pa.array(ids[:-1], pa.int64()), *columns], names=[c.split()[0] for c in SCHEMA.split(", ")])
                    yield out.filter(keep)
                ids, texts, ends = ids[-1:], texts[-1:], ends[-1:]
    return dealt.select("doc_id", "text", "end").mapInArrow(run, SCHEMA)
