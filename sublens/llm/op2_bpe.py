"""Operator 2, BPE encoding and decoding by dynamic programming over prefixes.

The encoding of every prefix of a pre-token ends in exactly one token.  For each prefix the
tokens that are suffixes of it are found by walking an automaton of the reversed vocabulary
backwards; the right one is compatible with the last token of the prefix it leaves, meaning
that merging by rank would never join anything across the border of the two.  Back-pointers
(token lengths) then give the ids from the end.  All prefixes of one length, over all new
pre-tokens of a batch, are decided together with array operations.  For a long pre-token the
matches of all prefixes of a block are found together, and the pairs already judged are kept.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sublens.llm.common import key_table, lookup, text_slices
from sublens.llm.op4_token_counts import surviving
from sublens.llm.pretokens import Memo, code_points, split
from sublens.llm.vocabulary import NONE, load, merged, ragged, split_added

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
ENCODED_SCHEMA = "doc_id bigint, ids array<int>"
LONG = 200  # bytes from which a pre-token is encoded by itself; cost only


@cache
def automaton(tokenizer: bytes):
    """Transitions (state, previous byte) -> state over the reversed vocabulary, and the symbol
    each state spells (-1: none).  Symbols that merging would not produce whole take no part."""
    vocab = load(tokenizer)
    whole = np.ones(vocab.n, dtype=bool)
    whole[256:] = surviving(vocab, vocab.content[256:]) == 1
    states: dict[int, int] = {}
    spelled = {}
    for k in np.flatnonzero(whole).tolist():
        state = 0
        for byte in reversed(vocab.content[k]):
            key = state << 8 | byte
            state = states.setdefault(key, len(states) + 1)
        spelled[state] = k
    spells = np.full(len(states) + 1, -1, dtype=np.int32)
    spells[list(spelled)] = list(spelled.values())
    table = key_table(np.fromiter(states, dtype=np.uint64, count=len(states)), np.fromiter(states.values(), dtype=np.int32, count=len(states)))
    return table, spells


def compatible(vocab, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging the bytes of a, b by rank gives just the tokens a, b.

    The later-made of the two sides is taken apart again and again; if at some point the two
    symbols at the border could have merged before either grew on, the pair is not stable.
    """
    out = np.zeros(len(a), dtype=bool)
    at, a, b = np.arange(len(a)), a.copy(), b.copy()
    below = np.full(len(a), NONE, dtype=np.int64)
    while len(at):
        joint = merged(vocab, a, b)
        stays = (joint < 0) | (joint >= below)
        at, a, b, below = at[stays], a[stays], b[stays], below[stays]
        left_first = (a > b) & (a >= 256) | (b < 256)  # which side to take apart; bytes cannot be
        ended = (a < 256) & (b < 256)
        out[at[ended]] = True
        below = np.where(left_first, a, b + 1)
        a, b = np.where(left_first, vocab.right[a], a), np.where(left_first, b, vocab.left[b])
        at, a, b, below = at[~ended], a[~ended], b[~ended], below[~ended]
    return out


def compatible_one(vocab, a: int, b: int) -> bool:
    """`compatible` for one pair."""
    below = NONE
    while True:
        if (joint := vocab.merge_of.get(a << 32 | b, NONE)) < below:
            return False
        if a < 256 and b < 256:
            return True
        if b < 256 or a > b:
            below, a = a, vocab.right_of[a]
        else:
            below, b = b + 1, vocab.left_of[b]


def encode_long(tokenizer: bytes, item: bytes, block: int = 1 << 17) -> list[int]:
    """Symbols of one byte sequence of any length, in time and memory linear in it."""
    vocab, (table, spells) = load(tokenizer), automaton(tokenizer)
    data = np.frombuffer(item, dtype=np.uint8)
    width_of = [len(c) for c in vocab.content]
    last: list[int] = []
    judged: dict[int, bool] = {}
    for begin in range(0, len(data), block):
        ends = np.arange(begin, min(begin + block, len(data)))
        state, found, back = np.zeros(len(ends), dtype=np.int64), [], 0
        while len(ends):
            state = lookup(table, state.astype(np.uint64) << np.uint64(8) | data[ends - back]).astype(np.int64)
            alive = state >= 0
            state, ends = state[alive], ends[alive]
            some = spells[state] >= 0
            found.append((ends[some], spells[state[some]].astype(np.int64)))
            back += 1
            inside = ends >= back
            state, ends = state[inside], ends[inside]
        at = np.concatenate([e for e, _ in found[::-1]])  # longest first
        by = np.argsort(at, kind="stable")
        symbols = np.concatenate([s for _, s in found[::-1]])[by].tolist()
        cuts = np.searchsorted(at[by], np.arange(begin, min(begin + block, len(data)) + 1)).tolist()
        for i, (a, b) in enumerate(zip(cuts, cuts[1:]), begin):
            for symbol in symbols[a:b]:
                before = i - width_of[symbol]
                if before < 0:
                    break
                pair = last[before] << 32 | symbol
                if (fits := judged.get(pair)) is None:
                    fits = judged[pair] = compatible_one(vocab, last[before], symbol)
                if fits:
                    break
            last.append(symbol)
        if len(judged) > 2_000_000:
            judged = {}
    out, i = [], len(last) - 1
    while i >= 0:
        out.append(last[i])
        i -= width_of[last[i]]
    return vocab.token_id[out[::-1]].tolist()


def encode_items(tokenizer: bytes, items: list[bytes]) -> list[list[int]]:
    """Ids of each non-empty byte sequence: short ones together, long ones each by itself."""
    short = [i for i, x in enumerate(items) if len(x) <= LONG]
    out: list[list[int]] = [[] for _ in items]
    for i, ids in zip(short, _encode_short(tokenizer, [items[i] for i in short])):
        out[i] = ids
    for i, x in enumerate(items):
        if len(x) > LONG:
            out[i] = encode_long(tokenizer, x)
    return out


def _encode_short(tokenizer: bytes, items: list[bytes]) -> list[list[int]]:
    vocab, (table, spells) = load(tokenizer), automaton(tokenizer)
    order = sorted(range(len(items)), key=lambda i: -len(items[i]))
    data, bounds = ragged([items[i] for i in order])
    first, lengths = bounds[:-1], np.diff(bounds)
    last = np.full(len(data), -1, dtype=np.int64)  # at i: the last symbol of the prefix that ends there
    widths = np.fromiter(map(len, vocab.content), dtype=np.int64, count=vocab.n)
    active = len(items)
    for i in range(int(lengths[0]) if len(items) else 0):
        while lengths[active - 1] <= i:
            active -= 1
        ends = first[:active] + i
        state, rows, found = np.zeros(active, dtype=np.int64), np.arange(active), []
        for back in range(i + 1):  # suffixes of growing length, while some token continues
            state = lookup(table, state.astype(np.uint64) << np.uint64(8) | data[ends[rows] - back]).astype(np.int64)
            alive = state >= 0
            state, rows = state[alive], rows[alive]
            if not len(rows):
                break
            symbol = spells[state]
            some = symbol >= 0
            found.append((rows[some], symbol[some].astype(np.int64), back + 1))
        for rows, symbol, width in reversed(found):
            open_ = last[ends[rows]] < 0
            rows, symbol = rows[open_], symbol[open_]
            if width <= i:
                right = compatible(vocab, last[ends[rows] - width], symbol)
                rows, symbol = rows[right], symbol[right]
            last[ends[rows]] = symbol
    out: list[list[int]] = [[] for _ in items]
    at, rows = bounds[1:] - 1, np.arange(len(items))
    taken, owners = [], []
    while len(rows):
        symbol = last[at]
        taken.append(symbol)
        owners.append(rows)
        at = at - widths[symbol]
        more = at >= first[rows]
        at, rows = at[more], rows[more]
    if taken:
        symbols, owner = np.concatenate(taken[::-1]), np.concatenate(owners[::-1])
        by = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[by], np.arange(len(items) + 1)).tolist()
        ids = vocab.token_id[symbols[by]].tolist()
        for k, a, b in zip(order, cuts, cuts[1:]):
            out[k] = ids[a:b]
    return out


def _solve(tokenizer: bytes, items: list[str]) -> list[tuple[int, str, bytes]]:
    """(number of ids, ids joined by commas, bytes that the ids stand for) of each pre-token."""
    of_id = load(tokenizer).of_id
    return [(len(ids), ",".join(map(str, ids)), b"".join([of_id[i] for i in ids])) for ids in encode_items(tokenizer, [x.encode() for x in items])]


def _pieces(texts: list[str], added: dict[str, int]):
    """Texts cut at added tokens: pieces, the text each belongs to, and (text, place, id, string) of the added tokens."""
    pieces, owner, special = [], [], []
    for i, text in enumerate(texts):
        for piece, token in split_added(text, added) if any(s in text for s in added) else [(text, -1)]:
            if token >= 0:
                special.append((len(pieces), token, piece.encode()))
            pieces.append("" if token >= 0 else piece)
            owner.append(i)
    return pieces, owner, special


def _per_text(texts: list[str], vocab, memo: Memo):
    """For each text the lists (counts, id strings, bytes) of its pre-tokens, in order."""
    pieces, owner, special = _pieces(texts, vocab.added)
    joined = "".join(pieces)
    points = code_points(joined)
    bounds = np.zeros(len(pieces) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in pieces], out=bounds[1:])
    start, _ = split(points, bounds[:-1][np.diff(bounds) > 0], leading_space=True)
    columns = [np.zeros(0, dtype=object)] * 3
    if len(start):
        values, inverse = memo.values(points, joined, start, np.append(start[1:], len(points)))
        for c in range(3):
            distinct = np.empty(len(values), dtype=object)
            distinct[:] = [v[c] for v in values]
            columns[c] = distinct[inverse]
    first = np.searchsorted(start, bounds).tolist()
    special_at = {k: (1, str(token), content) for k, token, content in special}
    if not special:
        for i in range(len(texts)):
            yield tuple(c[first[i]:first[i + 1]].tolist() for c in columns)
        return
    parts = [([], [], []) for _ in texts]
    for k, i in enumerate(owner):
        for c in range(3):
            parts[i][c].extend([special_at[k][c]] if k in special_at else columns[c][first[k]:first[k + 1]].tolist())
    yield from parts


def encode(docs: DataFrame, tokenizer: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids of each row's text (null text: empty list)."""
    def run(batches):
        vocab, memo = load(tokenizer), Memo(lambda items: _solve(tokenizer, items))
        for whole in batches:
            for batch in text_slices(whole, most=1_000_000):
                ids = [[int(i) for s in strings for i in s.split(",")] for _, strings, _ in _per_text([x or "" for x in batch.column("text").to_pylist()], vocab, memo)]
                yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])
    return _picked(docs, id_col, text_col).mapInArrow(run, ENCODED_SCHEMA)


def decode(encoded: DataFrame, tokenizer: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text that each row's ids stand for (null or no ids: empty text; bytes that
    are not UTF-8 become replacement characters)."""
    def run(batches):
        of_id = load(tokenizer).of_id
        for batch in batches:
            text = [b"".join([of_id[i] for i in ids or ()]).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])
    picked = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return picked.mapInArrow(run, "doc_id bigint, text string")


def round_trip_digests(docs: DataFrame, tokenizer: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again, keeping digests only.

    One row per row of `docs`: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas),
    decoded_sha256.  A null text is empty; ids may be null or repeat; other columns are ignored.
    """
    def run(batches):
        vocab, memo = load(tokenizer), Memo(lambda items: _solve(tokenizer, items), most=150_000)
        for whole in batches:
            for batch in text_slices(whole, most=1_000_000):
                n, ids, decoded = [], [], []
                for counts, strings, contents in _per_text([x or "" for x in batch.column("text").to_pylist()], vocab, memo):
                    n.append(sum(counts))
                    ids.append(hashlib.sha256(",".join(strings).encode()).hexdigest())
                    text = b"".join(contents).decode("utf-8", "replace")
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
                yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return _picked(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def _picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
