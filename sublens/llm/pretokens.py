"""Pre-tokens of byte-level vocabularies, found with array operations over many texts at once."""

from __future__ import annotations

import sys
from functools import cache

import numpy as np

from sublens.llm.common import prefix_sums, span_hashes

OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3
SURROGATES = range(0xD800, 0xE000)  # in no text


@cache
def classes() -> np.ndarray:
    """The class of every code point, as the tokenizers library's own patterns see it (its Unicode
    version, not Python's): the runs of each class in the string of all code points."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split
    points = [c for c in range(sys.maxunicode + 1) if c not in SURROGATES]
    runs = Split(Regex(r"\p{L}+|\p{N}+|\s+"), "removed", invert=True)
    found = [(at + a, at + b) for at in range(0, len(points), 1024)  # its time grows faster than the string
             for _, (a, b) in runs.pre_tokenize_str("".join(map(chr, points[at:at + 1024])))]
    firsts = "".join(chr(points[a]) + "-" for a, _ in found)  # one character of each run, for its class
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        for _, (i, _) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(firsts):
            a, b = found[i // 2]
            out[points[a:b]] = kind
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def split(points: np.ndarray, text_starts: np.ndarray, leading_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pre-tokens of concatenated texts, and the class of each one's first character.

    leading_space: one space before a run belongs to it and other white space makes tokens of its
    own (the byte-level pattern); otherwise white space makes tokens for the caller to drop, and
    each number character is a token.
    """
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    kind = classes()[points]
    text_start = np.zeros(n + 1, dtype=bool)
    text_start[text_starts] = True
    run = text_start[:n].copy()
    run[0] = True
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    if leading_space:
        last = np.flatnonzero(run[1:] & (kind[:-1] == BLANK) & ~text_start[1:n])
        start[last] = True
        start[last[points[last] == 0x20] + 1] = False
    else:
        start |= kind == NUMBER
    mark = np.flatnonzero(points == 0x27)
    mark = mark[start[mark] & run[mark] & (mark + 1 < n)]
    mark = mark[(kind[mark + 1] == LETTER) & ~text_start[mark + 1]]
    if len(mark):
        one = points[mark + 1]
        two = np.where((mark + 2 < n) & ~text_start[np.minimum(mark + 2, n)], points[np.minimum(mark + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        mark, length = mark[short | long], np.where(short, 2, 3)[short | long]
        start[mark + 1] = False
        after = mark + length
        after = after[after < n]
        start[after[~run[after]]] = True
    at = np.flatnonzero(start)
    return at, kind[at]


def distinct(points: np.ndarray, joined: str, start: np.ndarray, end: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct pre-tokens, and the index into them of each one.  Hashes group them; then every
    character of a group is compared with those of its first, and strings decide if two differ."""
    _, first, inverse = np.unique(span_hashes(prefix_sums(points), start, end), return_index=True, return_inverse=True)
    length = end - start
    same = bool((length == length[first][inverse]).all())
    if same:  # each character lies as far from its like as their pre-tokens' starts
        away = np.repeat((start[first][inverse] - start).astype(np.int32), length)
        at = np.arange(len(points), dtype=np.int32) if len(away) == len(points) else np.arange(len(away), dtype=np.int32) + np.repeat((start - np.cumsum(length) + length).astype(np.int32), length)
        same = bool((points[at] == points[at + away]).all())
    if not same:
        index: dict[str, int] = {}
        inverse = np.array([index.setdefault(joined[a:b], len(index)) for a, b in zip(start.tolist(), end.tolist())], dtype=np.int64)
        return list(index), inverse
    return [joined[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())], inverse


class Memo:
    """What is known of pre-tokens already met by this worker; emptied when it holds `most` of them
    or `most_chars` characters.

    solve(list of strings) returns one value for each."""

    def __init__(self, solve, most: int = 300_000, most_chars: int = 10_000_000):
        self.solve, self.most, self.most_chars = solve, most, most_chars
        self.known, self.chars = {}, 0

    def values(self, points, joined, start, end) -> tuple[list, np.ndarray]:
        """(values of the distinct pre-tokens, index into them for each pre-token)."""
        strings, inverse = distinct(points, joined, start, end)
        if len(self.known) + len(strings) > self.most or self.chars > self.most_chars:
            self.known, self.chars = {}, 0
        known = self.known
        new = [s for s in strings if s not in known]
        if new:
            known.update(zip(new, self.solve(new)))
            self.chars += sum(map(len, new))
        return [known[s] for s in strings], inverse
