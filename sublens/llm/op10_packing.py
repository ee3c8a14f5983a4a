"""Operator 10, best-fit packing with exact complements.

Texts become pieces of at most `capacity` tokens.  How pieces share sequences depends on their
lengths alone, so the plan is made from the number of pieces of each length (at most `capacity`
numbers, whatever the input's size): starting from the longest length left, a gap is closed by
one, two or three lengths that sum to it exactly, as far as the counts reach; where no such sum
exists, the longest length that fits goes in and the rest of the gap is tried again.  The same
combination is used as often as its counts allow.  Each piece then finds its place from its rank
among the pieces of its length, which tasks number locally and shift by the counts of earlier
tasks; no task sees more than its share of a common length.
"""

from __future__ import annotations

import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from sublens.llm.common import text_slices, written
from sublens.llm.pretokens import BLANK, Memo, code_points, split
from sublens.llm.vocabulary import byte_chars

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, local_rank bigint"
PLACED_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
PLAIN = 0x250  # below it normalisation leaves characters alone and lower-casing keeps their number
DOTTED_I = 0x130  # the exception


def _lower_table() -> np.ndarray:
    out = np.arange(PLAIN, dtype=np.uint32)
    for c in range(PLAIN):
        low = chr(c).lower()
        out[c] = ord(low) if len(low) == 1 else c
    return out


def _solve(model, items: list[str]) -> list[bytes]:
    """Ids (as little-endian uint32 bytes) of pre-tokens, by the library's own model."""
    shown = [x if x.isascii() and x.isprintable() else x.encode().decode("latin-1").translate(_SHOWN) for x in items]
    return [array("I", [t.id for t in model.tokenize(x)]).tobytes() for x in shown]


def _plain(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return ord(max(text)) < PLAIN and chr(DOTTED_I) not in text


def _ids(texts: list[str], tokenizer, memo: Memo) -> list[np.ndarray]:
    """Ids of each text.  Texts of plain characters are cut into pre-tokens with array operations
    and the library encodes each distinct pre-token once; it encodes all other texts itself."""
    out: list[np.ndarray] = [np.zeros(0, dtype="<u4")] * len(texts)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    own = [i for i, t in enumerate(texts) if not _plain(t) or any(s in t for s in special)]
    for i in own:
        out[i] = np.array(tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype="<u4")
    rest = sorted(set(range(len(texts))) - set(own))
    bounds = np.zeros(len(rest) + 1, dtype=np.int64)
    np.cumsum([len(texts[i]) for i in rest], out=bounds[1:])
    if not bounds[-1]:
        return out
    points = _LOWER[code_points("".join([texts[i] for i in rest]))]
    joined = points.astype("<u4").tobytes().decode("utf-32-le")
    start, kind = split(points, bounds[:-1][np.diff(bounds) > 0], leading_space=False)
    end = np.append(start[1:], len(points))
    start, end = start[kind != BLANK], end[kind != BLANK]
    first = np.searchsorted(start, bounds)
    if len(start):
        values, inverse = memo.values(points, joined, start, end)
        pool = np.frombuffer(b"".join(values), dtype="<u4")
        length = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
        begin = (np.cumsum(length) - length)[inverse]
        length = length[inverse]
        total = np.append(0, np.cumsum(length))
        flat = pool[np.repeat(begin - total[:-1], length) + np.arange(total[-1])]
        for k, i in enumerate(rest):
            out[i] = flat[total[first[k]]:total[first[k + 1]]]
    return out


_LOWER = _lower_table()
_SHOWN = {b: c for c, b in byte_chars().items()}


@cache
def _library(tokenizer: bytes):
    """The tokenizers library's object, once a worker: many small tasks don't each parse and hold one."""
    from tokenizers import Tokenizer
    library = Tokenizer.from_str(tokenizer.decode())
    library.no_truncation()
    library.no_padding()
    return library


def pieces(docs: DataFrame, tokenizer: bytes, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = False) -> DataFrame:
    """Pieces of each text's ids (with `end_id` after them), numbered by length within the task.

    Only documents longer than `capacity` are cut.  A null text is empty (one piece: the end id).
    with_ids adds the ids of each piece.
    """
    def run(batches):
        library = _library(tokenizer)
        model = library.model
        memo = Memo(lambda items: _solve(model, items), most=100_000)
        task, used = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for whole in batches:
            for batch in text_slices(whole, most=500_000):
                rows = [[] for _ in range(7 + with_ids)]
                texts = [x or "" for x in batch.column("text").to_pylist()]
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), _ids(texts, library, memo)):
                    ids = np.append(ids, np.array([end_id], dtype="<u4")).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at:at + capacity]
                        n = len(part)
                        values = (doc_id, k, at, n, zlib.crc32(part.tobytes()), task, used[n], part.tolist() if with_ids else None)
                        for column, value in zip(rows, values):
                            column.append(value)
                        used[n] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "local_rank", "ids"]
                yield pa.record_batch([pa.array(r, kind) for r, kind in zip(rows, kinds)], names=names[:len(rows)])
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, PIECE_SCHEMA + ", ids array<bigint>" * with_ids)


def _pair(count: np.ndarray, gap: int) -> tuple[int, int] | None:
    """The two lengths with the largest first that sum to `gap` and are still there."""
    both = np.flatnonzero((count[1:gap] > 0) & (count[gap - 1:0:-1] > 0)) + 1  # symmetric about gap / 2
    for a in both[::-1].tolist():
        if 2 * a < gap:
            break
        if 2 * a > gap or count[a] > 1:
            return a, gap - a
    return None


def _complement(count: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three lengths that sum to `gap` exactly."""
    if count[gap] > 0:
        return [gap]
    pair = _pair(count, gap)
    if pair:
        return list(pair)
    for a in np.flatnonzero(count[:gap - 1] > 0)[::-1].tolist():
        if 3 * a < gap:
            break  # the largest of three is a third at least
        count[a] -= 1
        rest = _pair(count, gap - a)
        count[a] += 1
        if rest:
            return [a, *rest]
    return None


def plan(counts: dict[int, int], capacity: int = 4096) -> list[tuple[int, dict[int, int]]]:
    """Combinations as (times, {length: uses in one sequence}) that use up all `counts`."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        count[length] = n
    out = []
    longest = capacity
    while True:
        while longest and not count[longest]:
            longest -= 1
        if not longest:
            return out
        left, use, gap = count.copy(), {longest: 1}, capacity - longest
        left[longest] -= 1
        while gap:
            found = _complement(left, gap)
            if not found:
                fits = np.flatnonzero(left[:gap + 1] > 0)
                if not len(fits):
                    break
                found = [int(fits[-1])]
            for a in found:
                left[a] -= 1
                use[a] = use.get(a, 0) + 1
                gap -= a
        times = min(int(count[a]) // n for a, n in use.items())
        for a, n in use.items():
            count[a] -= times * n
        out.append((times, use))


def _places(combinations: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, ...]:
    """Arrays over (length, first rank): key, first rank, uses, first sequence, offset in it."""
    rows, used, sequence = [], {}, 0
    for times, use in combinations:
        offset = 0
        for a, n in use.items():
            rank = used.get(a, 0)
            rows.append((a << 44 | rank, rank, n, sequence, offset))
            used[a] = rank + times * n
            offset += a * n
        sequence += times
    return tuple(np.array(c, dtype=np.int64) for c in zip(*sorted(rows))) if rows else (np.zeros(0, dtype=np.int64),) * 5


def pack(docs: DataFrame, tokenizer: bytes, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (, ids).

    Runs the encoding when called (the pieces are written to the shared scratch folder; the
    driver gets one count for each length).  An empty table gives an empty result; ids may be
    null or repeat, every row is packed; other columns are ignored.
    """
    made = written(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), "pieces")
    per_task = made.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    key, rank, uses, sequence, offset = _places(plan(counts, capacity))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    before = per_task.select("length", "task", F.coalesce(earlier, F.lit(0)).alias("earlier"))

    def place(batches):
        for batch in batches:
            length, at = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            row = np.searchsorted(key, length << 44 | at, side="right") - 1
            past = at - rank[row]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
                + [pa.array(sequence[row] + past // uses[row]), pa.array(offset[row] + past % uses[row] * length)]
                + ([batch.column("ids")] if with_ids else []),
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids])
    ranked = made.join(before, ["length", "task"]).withColumn("rank", F.col("local_rank") + F.col("earlier")).drop("task", "local_rank", "earlier")
    return ranked.mapInArrow(place, PLACED_SCHEMA + ", ids array<bigint>" * with_ids)
