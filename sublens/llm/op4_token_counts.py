"""Operator 4, token counts: rank-synchronous array merging.

Pre-tokens of many texts are held as one ragged array of symbols.  In each round every
sequence merges all occurrences of its lowest-rank pair at the same time (left to right where
they overlap), until no pair of any sequence can merge; the surviving symbols are the tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sublens.llm.common import sums_by, text_slices
from sublens.llm.pretokens import Memo, code_points, split
from sublens.llm.vocabulary import NONE, load, merged, ragged, split_added

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def _ranks(vocab, symbols: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ranks of the pairs that begin at `at`; NONE at the end of a sequence."""
    out = np.full(len(at), NONE, dtype=np.int32)
    inner = ~last[at]
    found = merged(vocab, symbols[at[inner]], symbols[at[inner] + 1])
    out[inner] = np.where(found < 0, NONE, found)
    return out


def surviving(vocab, items: list[bytes]) -> np.ndarray:
    """The number of symbols that remain of each non-empty byte sequence after all merges."""
    data, bounds = ragged(items)
    symbols, owner = data.astype(np.int64), np.arange(len(items))
    counts = np.zeros(len(items), dtype=np.int64)
    first = bounds[:-1]
    last = np.zeros(len(symbols), dtype=bool)
    last[bounds[1:] - 1] = True
    rank = _ranks(vocab, symbols, last, np.arange(len(symbols)))
    while len(owner):
        lengths = np.diff(np.append(first, len(symbols)))
        lowest = np.minimum.reduceat(rank, first)
        done = lowest == NONE
        if done.any():
            counts[owner[done]] = lengths[done]
            keep = np.repeat(~done, lengths)
            symbols, last, rank = symbols[keep], last[keep], rank[keep]
            owner, lengths, lowest = owner[~done], lengths[~done], lowest[~done]
            first = np.cumsum(lengths) - lengths
            if not len(owner):
                break
        hit = np.flatnonzero(rank == np.repeat(lowest, lengths))
        if len(hit) > 1:  # of overlapping occurrences every other one merges
            new = np.ones(len(hit), dtype=bool)
            new[1:] = np.diff(hit) > 1
            begin = np.flatnonzero(new)
            place = np.arange(len(hit)) - np.repeat(begin, np.diff(np.append(begin, len(hit))))
            hit = hit[place % 2 == 0]
        symbols[hit] = vocab.product[rank[hit] - 256]
        last[hit] = last[hit + 1]
        keep = np.ones(len(symbols), dtype=bool)
        keep[hit + 1] = False
        moved = np.cumsum(keep) - 1
        symbols, last, rank, at, first = symbols[keep], last[keep], rank[keep], moved[hit], moved[first]
        changed = np.zeros(len(symbols) + 1, dtype=bool)
        changed[at] = True
        changed[at - 1] = True  # the pair before; where a sequence begins, its neighbour's end stays NONE
        at = np.flatnonzero(changed[:-1])
        rank[at] = _ranks(vocab, symbols, last, at)
    return counts


def token_counts(docs: DataFrame, tokenizer: bytes, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    tokenizer: content of a byte-level vocabulary file.  A null text is empty (0 tokens); ids
    may be null or repeat, each row is counted by itself; other columns are ignored; an empty
    table gives an empty result.  Strings of added tokens inside a text count as that token.
    """
    def run(batches):
        vocab = load(tokenizer)
        memo = Memo(lambda items: surviving(vocab, [x.encode() for x in items]).tolist())
        for whole in batches:
            for batch in text_slices(whole):
                yield _counted(batch, vocab, memo, limit)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, SCHEMA)


def _counted(batch: pa.RecordBatch, vocab, memo: Memo, limit: int) -> pa.RecordBatch:
    texts = [x or "" for x in batch.column("text").to_pylist()]
    extra = np.zeros(len(texts), dtype=np.int64)
    pieces, owner = [], []
    for i, text in enumerate(texts):
        for piece, special in split_added(text, vocab.added) if any(s in text for s in vocab.added) else [(text, -1)]:
            if special >= 0:
                extra[i] += 1
            else:
                pieces.append(piece)
                owner.append(i)
    joined = "".join(pieces)
    points = code_points(joined)
    bounds = np.zeros(len(pieces) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in pieces], out=bounds[1:])
    start, _ = split(points, bounds[:-1], leading_space=True)
    n = extra
    if len(start):
        values, inverse = memo.values(points, joined, start, np.append(start[1:], len(points)))
        each = sums_by(np.array(values, dtype=np.int64)[inverse], np.searchsorted(start, bounds))
        n = n + np.bincount(owner, weights=each, minlength=len(texts)).astype(np.int64)
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
    return pa.record_batch([batch.column("doc_id"), sizes, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
