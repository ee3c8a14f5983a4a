"""A byte-level BPE vocabulary file as arrays: merges, halves of each token, bytes of each id."""

from __future__ import annotations

import json
from functools import cache
from types import SimpleNamespace

import numpy as np

from sublens.llm.common import key_table, lookup

NONE = np.iinfo(np.int32).max


def byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@cache
def load(blob: bytes) -> SimpleNamespace:
    """Parse a tokenizer file (its content, so that executors need no path).

    Symbols are ranked: bytes 0-255 first, then 256 + rank for the product of each merge;
    `token_id` gives the vocabulary id of a symbol.
    """
    spec = json.loads(blob)
    vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    to_byte = byte_chars()
    symbol: dict[str, int] = {c: b for c, b in to_byte.items()}
    for rank, (a, b) in enumerate(merges):
        symbol.setdefault(a + b, 256 + rank)
    n = 256 + len(merges)
    left, right = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64)
    left[256:] = [symbol[a] for a, _ in merges]
    right[256:] = [symbol[b] for _, b in merges]
    token_id = np.full(n, -1, dtype=np.int64)
    content: list[bytes] = [b""] * n
    for s, k in symbol.items():
        token_id[k] = vocab.get(s, -1)
        content[k] = bytes(to_byte[c] for c in s)
    product = np.array([symbol[a + b] for a, b in merges], dtype=np.int64)
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    of_id = {int(token_id[k]): content[k] for k in range(n) if token_id[k] >= 0} | {i: s.encode() for s, i in added.items()}
    pair = key_table(left[256:].astype(np.uint64) << np.uint64(32) | right[256:].astype(np.uint64), np.arange(256, n, dtype=np.int32))
    merge_of = {a << 32 | b: k for k, (a, b) in enumerate(zip(left[256:].tolist(), right[256:].tolist()), 256)}
    return SimpleNamespace(merge_of=merge_of, left_of=left.tolist(), right_of=right.tolist(), n=n, left=left, right=right, token_id=token_id, content=content, product=product, added=added, of_id=of_id, pair=pair)


def merged(vocab, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The symbol (256 + rank) that each pair merges into, -1 for none."""
    return lookup(vocab.pair, a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))


def ragged(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, bounds n+1)."""
    bounds = np.zeros(len(items) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in items], out=bounds[1:])
    return np.frombuffer(b"".join(items), dtype=np.uint8), bounds


def split_added(text: str, added: dict[str, int]) -> list[tuple[str, int]]:
    """`text` cut at the added tokens' strings: (piece, -1) or (string, id), leftmost first."""
    out, rest = [], text
    while True:
        found = min(((rest.find(s), -len(s), s) for s in added if s in rest), default=None)
        if found is None:
            return [*out, (rest, -1)]
        at, _, s = found
        out += [(rest[:at], -1), (s, added[s])]
        rest = rest[at + len(s):]
