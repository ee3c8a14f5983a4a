"""Operators 2, 4 and 10 against the tokenizers library."""
import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from sublens.llm import op2_bpe, op4_token_counts, op10_packing
from sublens.llm.queries import vocabulary_file

tokenizers = pytest.importorskip("tokenizers")
ALPHABET = "aabbst'''  \n\t\r\x1c\x85\xa0reveldm 12٣é漢字😀!?.-AŹİΣ"


def library(name):
    return tokenizers.Tokenizer.from_str(vocabulary_file(name).decode())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    out += ["", "<|endoftext|>a <|endoftext|>", "x<|startoftext|>", "a" * 5000, "ab" * 900, "the cat's " * 3000, " \n \n x", "the cat's " * 3000]
    return out


@pytest.fixture
def docs(spark, texts):
    rows = [(i, t, "z", "clash") for i, t in enumerate(texts)] + [(None, "no id", None, None), (5, None, None, None), (5, "same id", None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string, length string").repartition(3)


def expected(name, text):
    return library(name).encode(text or "", add_special_tokens=False).ids


def test_round_trip_and_counts(spark, docs):
    blob, lib = vocabulary_file("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    want = sorted((r.doc_id is not None, r.doc_id, len(ids := lib.encode(r.text or "", add_special_tokens=False).ids),
                   hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest(), len((r.text or "").encode())) for r in docs.collect())
    got = op2_bpe.round_trip_digests(docs, blob).collect()
    assert sorted((r.doc_id is not None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == [w[:5] for w in want]
    got = op4_token_counts.token_counts(docs, blob).collect()
    assert sorted((r.doc_id is not None, r.doc_id, r.n_tokens, r.n_bytes) for r in got) == sorted((w[0], w[1], w[2], w[5]) for w in want)
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_encode_then_decode(docs):
    blob = vocabulary_file("byte_bpe_50k.json")
    back = op2_bpe.decode(op2_bpe.encode(docs, blob), blob)
    key = lambda r: (r.doc_id is not None, r.doc_id, r.text or "")
    assert sorted(map(key, back.collect())) == sorted(map(key, docs.collect()))


def test_every_pair_of_tokens_is_judged_as_merging_does():
    import numpy as np
    blob = vocabulary_file("byte_bpe_50k.json")
    vocab = op2_bpe.load(blob)
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3000, 3000), rng.integers(0, 3000, 3000)
    items = [vocab.content[x] + vocab.content[y] for x, y in zip(a, b)]
    encoded = op2_bpe.encode_items(blob, items)
    want = [ids == [vocab.token_id[x], vocab.token_id[y]] for ids, x, y in zip(encoded, a, b)]
    assert op2_bpe.compatible(vocab, a, b).tolist() == want
    assert op4_token_counts.surviving(vocab, items).tolist() == [len(e) for e in encoded]


def test_every_code_point_as_the_library_splits_it():
    """Each code point between letters, digits and signs: assigned in Python's Unicode or not."""
    lib, blob = library("byte_bpe_50k.json"), vocabulary_file("byte_bpe_50k.json")
    vocab = op2_bpe.load(blob)
    memo = op2_bpe.Memo(lambda items: op2_bpe._solve(blob, items))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x32000 or 0xE0000 <= c < 0xE0200 or c % 997 == 0)]
    for at in range(0, len(points), 4000):
        texts = [f"a{chr(c)}b1{chr(c)}2.{chr(c)}! {chr(c)}{chr(c)} x" for c in points[at:at + 4000]]
        want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
        got = [[int(i) for x in strings for i in x.split(",")] for _, strings, _ in op2_bpe._per_text(texts, vocab, memo)]
        assert got == want
        joined = "".join(texts)
        bounds = [0]
        for t in texts:
            bounds.append(bounds[-1] + len(t))
        start, _ = op4_token_counts.split(op4_token_counts.code_points(joined), bounds[:-1], leading_space=True)
        assert len(start) == sum(len(lib.pre_tokenizer.pre_tokenize_str(t)) for t in texts)


@pytest.mark.parametrize("letters", ["ab", "abcdefghij", "thequickbrownfoxéß漢"])
def test_long_pre_tokens(letters):
    rng = random.Random(len(letters))
    text = "".join(rng.choice(letters) for _ in range(60_000))
    blob = vocabulary_file("byte_bpe_50k.json")
    want = library("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids
    assert op2_bpe.encode_items(blob, [text.encode(), b"x"])[0] == want
    assert op2_bpe.encode_long(blob, text.encode(), block=777) == want


def test_a_pre_token_of_a_million_characters_within_a_minute():
    import time
    rng = random.Random(9)
    blob, data = vocabulary_file("byte_bpe_50k.json"), bytes(rng.choices(range(97, 123), k=1_000_000))
    op2_bpe.automaton(blob)
    began = time.process_time()
    ids = op2_bpe.encode_items(blob, [data])[0]
    assert time.process_time() - began < 60
    assert b"".join(op2_bpe.load(blob).of_id[i] for i in ids) == data


def test_pre_tokens_of_equal_hash_are_told_apart(monkeypatch):
    import numpy as np
    from sublens.llm import pretokens
    monkeypatch.setattr(pretokens, "span_hashes", lambda sums, start, end: np.zeros(len(start), dtype=np.uint64))
    joined = "abcabcabdab"
    start, end = np.array([0, 3, 6, 9]), np.array([3, 6, 9, 11])
    strings, inverse = pretokens.distinct(pretokens.code_points(joined), joined, start, end)
    assert [strings[i] for i in inverse] == ["abc", "abc", "abd", "ab"]


def check_packing(rows, texts_of, capacity, lib):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, text in texts_of.items():
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        cuts = [ids[i:i + capacity] for i in range(0, len(ids), capacity)]
        got = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in got] == [
            (k, k * capacity, len(c), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in c))) for k, c in enumerate(cuts)]
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(spark, texts, capacity):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, None])], "doc_id bigint, text string, length int").repartition(4)
    lib = library("word_bpe_49k.json")
    rows = op10_packing.pack(docs, vocabulary_file("word_bpe_49k.json"), capacity).collect()
    n = check_packing(rows, dict(enumerate([*texts, None])), capacity, lib)
    assert n <= 1.01 * sum(r.length for r in rows) / capacity + 2


def test_packing_repeats_and_empty(spark):
    docs = spark.createDataFrame([(7, "one two three")] * 50 + [(None, None)] * 3, "doc_id bigint, text string").repartition(5)
    rows = op10_packing.pack(docs, vocabulary_file("word_bpe_49k.json"), 10, with_ids=True).collect()
    assert len(rows) == 53 and len({(r.sequence_id, r.offset) for r in rows}) == 53 and all(len(r.ids) == r.length for r in rows)
    assert op10_packing.pack(docs.limit(0), vocabulary_file("word_bpe_49k.json")).count() == 0
    assert op4_token_counts.token_counts(docs.limit(0), vocabulary_file("byte_bpe_50k.json")).count() == 0


def test_plan_closes_gaps_exactly():
    combos = op10_packing.plan({60: 3, 40: 1, 25: 2, 15: 2, 20: 2, 10: 2, 7: 1}, 100)
    used = defaultdict(int)
    for times, use in combos:
        assert sum(a * n for a, n in use.items()) <= 100
        for a, n in use.items():
            used[a] += times * n
    assert used == {60: 3, 40: 1, 25: 2, 15: 2, 20: 2, 10: 2, 7: 1}
    assert sum(t for t, _ in combos) == 4


def test_packing_holds_one_tokenizer_a_worker():
    """Many small tasks of a worker share it."""
    import public_tokenizers
    from sublens.llm import op10_packing
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        blob = f.read()
    assert op10_packing._library(blob) is op10_packing._library(bytes(bytearray(blob)))
