"""Operator 6, secret scans with a recursive decoding worklist.

Every text is a layer, and so is what its URL escapes, Unicode escapes, base64 runs (also over
line ends) and compressed contents decode to.  Each layer is scanned with the same patterns and unwrapped in
turn until nothing new appears; layers already met at the same place are not taken again, so
cycles end.  Spans found in a layer are mapped back to the characters of the original text.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sublens.llm.common import text_slices

SCHEMA = ("doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, "
          "found array<struct<kind:string,start:int,end:int,layer:string>>")
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so this is every run of 32 or more
URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|(?:\\u|%u)([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{19,}={0,2}")
LEAST_BASE64 = 19  # characters without padding: no secret of these kinds is shorter than 14 bytes
LINE_END = r"[ \t]*+(?:\r\n?|\n|(?:\\r)?\\n)[ \t>]*+"  # of a text, of one in quotes (\n as two characters), of a mail that is quoted
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{LINE_END}[A-Za-z0-9+/_-]++)++={{0,2}}")
LINE = re.compile(rf"(?:^|{LINE_END})([A-Za-z0-9+/_-]++=*+)")


def matches(text: str, maybe_hex: bool = True) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if maybe_hex:
        found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return found


class Place:
    """Where the characters of a layer come from: pieces (from, origin start, origin end, step).

    step 1: characters follow one another in the origin; 0: each stands for the whole origin span.
    """

    def __init__(self, pieces):
        self.pieces = pieces
        self.froms = [p[0] for p in pieces]

    def span(self, start: int, end: int) -> tuple[int, int]:
        a, b = (self.pieces[bisect_right(self.froms, x) - 1] for x in (start, end - 1))
        return a[1] + (start - a[0]) * a[3], b[1] + end - b[0] if b[3] else b[2]


def _replaced(text: str, place: Place, found: list[tuple[int, int, list[tuple[str, int]]]]) -> tuple[str, Place]:
    """`text` with spans replaced: found = (start, end, [(character, source length)...])."""
    out, pieces, n, at = [], [], 0, 0

    def copy(a: int, b: int):
        nonlocal n
        while a < b:  # keep pieces of the parent apart
            i = bisect_right(place.froms, a) - 1
            stop = min(b, place.froms[i + 1] if i + 1 < len(place.froms) else b)
            s, e = place.span(a, stop)
            pieces.append((n, s, e, place.pieces[i][3]))
            out.append(text[a:stop])
            n, a = n + stop - a, stop
    for start, end, characters in found:
        copy(at, start)
        source = start
        for c, length in characters:
            pieces.append((n, *place.span(source, source + length), 0))
            out.append(c)
            n, source = n + 1, source + length
        at = end
    copy(at, len(text))
    return "".join(out), Place(pieces or [(0, 0, 0, 0)])


def _url(text: str):
    for m in URL.finditer(text):
        raw = bytes.fromhex(m[0].replace("%", ""))
        try:
            yield m.start(), m.end(), [(c, 3 * len(c.encode())) for c in raw.decode()]
        except UnicodeDecodeError:
            yield m.start(), m.end(), [(chr(b), 3) for b in raw]


def _escapes(text: str):
    high = None  # a high surrogate waits for its other half
    for m in ESCAPE.finditer(text):
        digits = next(i for i in range(1, 7) if m[i])
        code = int(m[digits], 10 if digits == 6 else 16)
        if high and high[1] == m.start() and 0xDC00 <= code < 0xE000:
            joint = chr(0x10000 + ((high[2] - 0xD800) << 10) + code - 0xDC00)
            yield high[0], m.end(), [(joint, m.end() - high[0])]
            high = None
            continue
        high = None
        if 0xD800 <= code < 0xDC00:
            high = (m.start(), m.end(), code)
        elif code < 0x110000 and not 0xD800 <= code < 0xE000:
            yield m.start(), m.end(), [(chr(code), m.end() - m.start())]


def _opener(raw: bytes):
    """A decompressor (each format expands by a bounded factor) for what `raw` starts with, or None."""
    if raw[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if raw[:1] == b"\x78" and len(raw) > 5 and not (raw[0] << 8 | raw[1]) % 31:
        return zlib.decompressobj()
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=1 << 28)
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard
        return zstandard.ZstdDecompressor().decompressobj()
    return None


def _inflate(raw: bytes) -> tuple[bytes, int] | None:
    """What the streams at the start of `raw` hold together, and their length; None if there are none."""
    out, rest = [], raw
    try:
        while rest and (opener := _opener(rest)):
            out.append(opener.decompress(rest))
            rest = opener.unused_data
    except Exception as error:  # noqa: BLE001 - damaged data of any format is no layer
        if isinstance(error, MemoryError):
            raise
    return (b"".join(out), len(raw) - len(rest)) if out else None


def _readings(text: str):
    """Lists of pieces (start, end) that may be base64 together, longer ones of the same lines first.

    Of consecutive lines of base64 characters: all of them; from each line that is not as long as
    the one before, lines of equal length (the first may differ) and a shorter last one; and each
    long run alone."""
    if "\n" in text or "\r" in text or "\\n" in text:
        for m in WRAPPED.finditer(text):
            if m.end() - m.start() < LEAST_BASE64:
                continue
            lines = [x.span(1) for x in LINE.finditer(text[m.start():m.end()])]
            lines = [(m.start() + a, m.start() + b) for a, b in lines]
            sizes = [b - a for a, b in lines]
            yield lines
            stop = 1  # the end of the stretch of equal lines that holds line i + 1
            for i in range(len(lines) - 1):
                if i and sizes[i] == sizes[i - 1]:
                    continue
                stop = max(stop, i + 2)
                while stop < len(lines) and sizes[stop] == sizes[i + 1]:
                    stop += 1
                end = stop + (stop < len(lines) and sizes[stop] < sizes[i + 1])
                if (i, end) != (0, len(lines)):
                    yield lines[i:end]
    for m in BASE64.finditer(text):
        yield [m.span()]


def _base64(text: str):
    """(decoded text, pieces (from, start, end) for its lines, name of the layer) of runs, also over
    line ends; bytes that are not UTF-8 are replaced."""
    taken: dict[int, tuple[int, bool]] = {}  # start of a line read with those before it: end of that reading, inflated
    for lines in _readings(text):
        runs = [text[a:b].rstrip("=") for a, b in lines]
        run = "".join(runs)
        run = run[:-1] if len(run) % 4 == 1 else run
        if len(run) < LEAST_BASE64:
            continue
        end, inflated = taken.get(lines[0][0], (0, False))
        if inflated and end >= lines[-1][1]:
            continue
        try:
            raw = base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4))
        except binascii.Error:
            continue
        name, inner = "base64", _inflate(raw)
        if inner is None and end >= lines[-1][1]:
            continue
        firsts = [0, *accumulate(map(len, runs))][:-1]  # of each line, in characters of the run
        if inner is None:
            pieces, found, at, n = [], [], 0, 0
            decoder = codecs.getincrementaldecoder("utf-8")("replace")
            for k, (a, b) in enumerate(lines):
                last = k + 1 == len(lines)
                cut = len(raw) if last else min(len(raw), firsts[k + 1] * 3 // 4)
                over = bool(firsts[k] % 4) + bool(decoder.getstate()[0])  # characters that may stand over the line end
                if part := decoder.decode(raw[at:cut], last):
                    pieces += [(n, lines[k - 1][0], b)] * bool(over) + [(n + over, a, b)] * (len(part) > over)
                    found.append(part)
                    n += len(part)
                at = cut
            found = "".join(found)
        else:
            used = (inner[1] * 4 + 2) // 3
            lines, firsts = [x for x, first in zip(lines, firsts) if first < used], [first for first in firsts if first < used]
            raw = inner[0]
            name = "base64>inflate"
            while (inner := _inflate(raw)) is not None:
                name, raw = name + ">inflate", inner[0]
            found, pieces = raw.decode("utf-8", "replace"), [(0, lines[0][0], lines[-1][1])]
        if len(lines) > 1:
            for first, (a, b) in zip(firsts, lines):
                if first % 4 == 0:
                    taken[a] = max(taken.get(a, (0, False)), (lines[-1][1], "inflate" in name))
        if found:
            yield found, pieces, name


def scan(text: str, maybe_hex: bool = True) -> tuple[list[tuple[int, str, int]], set[tuple[int, str, int, str]]]:
    """(base matches, (start, kind, end, layer) over all layers) of one text."""
    base = matches(text, maybe_hex)
    found = {(*b, "") for b in base}
    work = [(text, Place([(0, 0, len(text), 1)]), "")]
    seen = {(text, 0, len(text))}
    while work:
        layer, place, name = work.pop()
        if name:
            found |= {(*(s := place.span(a, b))[:1], kind, s[1], name) for a, kind, b in matches(layer)}
        children = []
        if "%" in layer and (hits := list(_url(layer))):
            children.append((*_replaced(layer, place, hits), "url"))
        if ("\\" in layer or "&#" in layer or "%u" in layer) and (hits := list(_escapes(layer))):
            children.append((*_replaced(layer, place, hits), "unicode"))
        for inner, pieces, kind in _base64(layer):
            children.append((inner, Place([(n, *place.span(a, b), 0) for n, a, b in pieces]), kind))
        for inner, where, kind in children:
            if inner and (key := (inner, *where.span(0, len(inner)))) not in seen:
                seen.add(key)
                work.append((inner, where, f"{name}>{kind}" if name else kind))
    return base, found


_HEX = np.zeros(256, dtype=bool)
_HEX[[*b"0123456789abcdef"]] = True


def _maybe_hex(column: pa.Array) -> np.ndarray:
    """Texts that can hold 32 hex digits in a row: some 8 bytes, 4 apart, are all hex digits."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32 if pa.types.is_string(column.type) else np.int64)[column.offset:column.offset + len(column) + 1]
    out = np.zeros(len(column), dtype=bool)
    if column.buffers()[2] is not None and offsets[-1] > offsets[0]:
        some = _HEX[np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]][::4]]
        for step in (1, 2, 4):
            some = some[:-step] & some[step:]
        out[np.searchsorted(offsets, np.flatnonzero(some) * 4 + offsets[0], side="right") - 1] = True
    return out


def listed(spans) -> str:
    """kind:start:end by start, then kind, comma-joined."""
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted({(a, order[k], b, k) for a, k, b in spans}))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, counts of base matches, base_sha256, spans, found.

    spans lists base matches and those of decoded layers (code points, end exclusive); found has
    them with the layer they came from ("" for the text itself).  A null text is empty; ids may
    be null or repeat; other columns are ignored; an empty table gives an empty result.
    """
    def run(batches):
        for whole in batches:
            for batch in text_slices(whole):
                rows = [[] for _ in range(6)]
                for text, maybe in zip(batch.column("text").to_pylist(), _maybe_hex(batch.column("text")).tolist()):
                    base, found = scan(text or "", maybe)
                    for i, kind in enumerate(KINDS):
                        rows[i].append(sum(k == kind for _, k, _ in base))
                    rows[3].append(hashlib.sha256(listed(base).encode()).hexdigest())
                    rows[4].append(listed(x[:3] for x in found))
                    rows[5].append([{"kind": k, "start": a, "end": b, "layer": layer} for a, k, b, layer in sorted(found)])
                kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("layer", pa.string())]))]
                yield pa.record_batch([batch.column("doc_id"), *[pa.array(r, k) for r, k in zip(rows, kinds)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, SCHEMA)


def redacted(text: str, mask: str = "[secret]") -> str:
    """`text` with every found span (overlapping ones as one) replaced by `mask`."""
    out, at = [], 0
    for a, _, b, _ in sorted(scan(text)[1]):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])
