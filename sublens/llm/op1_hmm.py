"""Operator 1, LM scoring with a hidden Markov language model.

Tokens are words (A-Z lowered) and one end per text.  The corpus is counted whole.  Symbols of
the model are the `head` most frequent words, a fixed number of spelling classes for all other
words, and the end; a word of a class has the probability of the class in the state times its
own share in the class (add-half counts, one slot for words never seen), so the model is a
distribution over all texts.  Baum-Welch runs over all training rows: tasks add up expected
counts of states, transitions and symbols over blocks of `block` tokens, Spark sums them, the
driver gets states x symbols numbers.  Scores are the scaled forward recursion over the whole
sequence, so exact.

Counts of the `table` most frequent words travel to the tasks (a fixed bound); the counts of all
other words are joined by word, summed for each row.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from sublens.llm.common import text_slices, written

HEAD, CLASSES, TABLE, STATES = 1 << 14, 256, 1 << 17, 8
END = HEAD + CLASSES
SYMBOLS = END + 1
ENCODED = ("rid bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, log_counts double, log_class double, "
           "symbols binary, rare array<struct<word:binary,n:int>>")


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z alone are lowered, ASCII white space alone separates


def spelling_class(word: bytes) -> int:
    return ((word[-1] * 31 + word[-2:][0] * 7) & 63) << 2 | min(3, len(word) >> 2)


def word_counts(rows: DataFrame) -> DataFrame:
    """word, n over rows (text)."""
    def run(batches):
        held: Counter = Counter()

        def flush():
            out = pa.record_batch([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out
        for whole in batches:
            for batch in text_slices(whole, most=1_000_000):
                for text in batch.column("text").to_pylist():
                    held.update(_words(text))
                if len(held) > 400_000:
                    yield flush()
        yield flush()
    return rows.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _class_totals(counts: DataFrame, head: frozenset) -> np.ndarray:
    """For each class the tokens and the distinct words outside `head`, (CLASSES, 2)."""
    def run(batches):
        totals = np.zeros((CLASSES, 2), dtype=np.int64)
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                if word not in head:
                    totals[spelling_class(word)] += (n, 1)
        yield pa.record_batch([pa.array(range(CLASSES), pa.int32()), pa.array(totals[:, 0]), pa.array(totals[:, 1])], names=["class", "n", "words"])
    summed = counts.mapInArrow(run, "class int, n bigint, words bigint").groupBy("class").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).toArrow()
    out = np.zeros((CLASSES, 2))
    out[summed.column("class").to_numpy()] = np.stack([summed.column("n").to_numpy(), summed.column("words").to_numpy()], axis=1)
    return out


def encoded(rows: DataFrame, words: list[bytes], counts: np.ndarray, n_end: int, totals: np.ndarray) -> DataFrame:
    """Rows (doc_id, held_out, text) as symbols, with sums of log counts and the words outside the table."""
    logs = np.log10(counts + 0.5)
    class_norm = np.log10(totals[:, 0] + 0.5 * (totals[:, 1] + 1))
    end_log = float(np.log10(n_end + 0.5))

    def run(batches):
        index = {w: i for i, w in enumerate(words)}
        classes = np.array([spelling_class(w) for w in words], dtype=np.int64)
        symbol = np.where(np.arange(len(words)) < HEAD, np.arange(len(words)), HEAD + classes).astype(np.int64)
        own = np.where(np.arange(len(words)) < HEAD, 0.0, logs - class_norm[classes]) if len(words) else np.zeros(0)
        log_list = logs
        task, k = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in text_slices(whole, most=1_000_000):
                out = [[] for _ in range(8)]
                for text in batch.column("text").to_pylist():
                    tokens = _words(text)
                    at = np.array([index.get(w, -1) for w in tokens], dtype=np.int64)
                    rare_at = np.flatnonzero(at < 0).tolist()
                    symbols = symbol[at] if len(words) else at.copy()
                    seen = at[at >= 0]
                    log_counts, log_class = float(log_list[seen].sum()), float(own[seen].sum())
                    rare = Counter()
                    for i in rare_at:
                        word = tokens[i]
                        c = spelling_class(word)
                        symbols[i] = HEAD + c
                        log_class -= class_norm[c]
                        rare[word] += 1
                    values = ((task << 33) + k, len(tokens) + 1, len(seen) + (n_end > 0), log_counts + end_log, log_class,
                              np.append(symbols, END).astype("<u2").tobytes(), [{"word": w, "n": n} for w, n in rare.items()])
                    for column, value in zip(out, values):
                        column.append(value)
                    k += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), batch.column("doc_id"), batch.column("held_out"), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                     pa.array(out[3], pa.float64()), pa.array(out[4], pa.float64()), pa.array(out[5], pa.binary()),
                     pa.array(out[6], pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())])))],
                    names=["rid", "doc_id", "held_out", "n_tokens", "known", "log_counts", "log_class", "symbols", "rare"])
    return rows.mapInArrow(run, ENCODED)


def _by_time(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all sequences step by step (longest sequence first in each step): (order of the
    sequences, symbols, bounds of the steps)."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[order]
    active = np.searchsorted(-sorted_lengths, -np.arange(sorted_lengths[0]), side="left")  # longer than t
    bounds = np.append(0, np.cumsum(active))
    flat = np.concatenate([sequences[i] for i in order])
    first = np.cumsum(sorted_lengths) - sorted_lengths
    step = np.arange(len(flat)) - np.repeat(first, sorted_lengths)
    out = np.empty(len(flat), dtype=np.int64)
    out[bounds[step] + np.repeat(np.arange(len(order)), sorted_lengths)] = flat
    return order, out, bounds


def log_likelihoods(model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each sequence of symbols (none empty): scaled forward recursion."""
    start, move, emit = model
    order, symbols, bounds = _by_time(sequences)
    total = np.zeros(len(order))
    for t, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        n = b - a
        alpha = (alpha[:n] @ move if t else start) * emit[symbols[a:b]]  # noqa: F821
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:n] += np.log10(scale)
    out = np.empty(len(order))
    out[order] = total
    return out


def expected_counts(model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions (symbols x states) over sequences, and their log10 likelihood."""
    start, move, emit = model
    _, symbols, bounds = _by_time(sequences)
    chance = emit[symbols]
    alpha, scale = np.empty_like(chance), np.empty(len(symbols))
    cuts = bounds.tolist()
    for t, (a, b) in enumerate(zip(cuts, cuts[1:])):
        x = (alpha[cuts[t - 1]:cuts[t - 1] + b - a] @ move if t else start) * chance[a:b]
        scale[a:b] = x.sum(axis=1)
        alpha[a:b] = x / scale[a:b, None]
    beta = np.ones_like(chance)
    chance /= scale[:, None]
    back = move.T.copy()
    for t in range(len(cuts) - 3, -1, -1):
        a, b = cuts[t + 1], cuts[t + 2]
        beta[cuts[t]:cuts[t] + b - a] = (chance[a:b] * beta[a:b]) @ back
    later = slice(cuts[1], None)
    steps = np.repeat(np.arange(1, len(cuts) - 1), np.diff(bounds)[1:])
    before = bounds[steps - 1] + np.arange(cuts[1], len(symbols)) - bounds[steps]
    moves = alpha[before].T @ (chance[later] * beta[later]) * move
    alpha *= beta
    emitted = np.stack([np.bincount(symbols, weights=alpha[:, k], minlength=len(emit)) for k in range(len(start))], axis=1)
    return alpha[:cuts[1]].sum(axis=0), moves, emitted, float(np.log10(scale).sum())


def _normal(starts, moves, emitted, unigram) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A model from counts; emissions are smoothed towards the corpus's own shares of symbols."""
    start = (starts + 0.1) / (starts + 0.1).sum()
    move = (moves + 0.1) / (moves + 0.1).sum(axis=1, keepdims=True)
    emit = emitted + 20 * unigram[:, None]
    return start, move, emit / emit.sum(axis=0)


def _sequences(column: pa.Array, most: int):
    """Lists of symbol arrays, about `most` symbols at a time."""
    held, n = [], 0
    for value in column.to_pylist():
        held.append(np.frombuffer(value, dtype="<u2"))
        n += len(held[-1])
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def baum_welch(training: DataFrame, unigram: np.ndarray, states: int = STATES, rounds: int = 3, block: int = 256, seed: int = 3):
    """Train on rows (symbols).  States begin as the corpus's shares of symbols with fixed noise."""
    rng = np.random.default_rng(seed)
    emit = unigram[:, None] * rng.uniform(0.2, 1.8, (len(unigram), states)) ** 2
    model = np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(axis=0)
    names = [f"s{k}" for k in range(states)]
    schema = "row int, " + ", ".join(f"{c} double" for c in names)
    for _ in range(rounds):
        def run(batches, model=model):
            starts, moves, emitted = np.zeros(states), np.zeros((states, states)), np.zeros((len(unigram), states))
            for batch in batches:
                for sequences in _sequences(batch.column("symbols"), 300_000):
                    blocks = [s[i:i + block].astype(np.int64) for s in sequences for i in range(0, len(s), block)]
                    for target, found in zip((starts, moves, emitted), expected_counts(model, blocks)):
                        target += found
            rows = np.concatenate([starts[None], moves, emitted])
            some = np.flatnonzero(rows.any(axis=1))
            yield pa.record_batch([pa.array(some.astype(np.int32)), *[pa.array(rows[some, k]) for k in range(states)]], names=["row", *names])
        summed = training.select("symbols").mapInArrow(run, schema).groupBy("row").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
        rows = np.zeros((1 + states + len(unigram), states))
        rows[summed.column("row").to_numpy()] = np.stack([summed.column(c).to_numpy() for c in names], axis=1)
        model = _normal(rows[0], rows[1:1 + states], rows[1 + states:], unigram)
    return model


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Learns from rows that aren't held out, when called.  A null text is empty and holds one end.
    Without training rows base_score is 0 and the model is uniform over its symbols.  Ids may be
    null or repeat; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    training = rows.where(~F.col("held_out"))
    counts = written(word_counts(training), "words")
    n_end = training.count()
    n_words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_all, n_distinct = n_words + n_end, distinct + (n_end > 0)
    table = counts.orderBy(F.desc("n"), "word").limit(TABLE).toArrow()  # a fixed bound
    words, known = table.column("word").to_pylist(), table.column("n").to_numpy().astype(np.float64)
    totals = _class_totals(counts, frozenset(words[:HEAD]))
    coded = written(encoded(rows, words, known, n_end, totals), "symbols")

    unigram = np.zeros(SYMBOLS)
    unigram[:min(HEAD, len(words))] = known[:HEAD]
    unigram[HEAD:END] = totals[:, 0]
    unigram[END] = n_end
    unigram = (unigram + 0.5) / (unigram + 0.5).sum()
    model = baum_welch(coded.where(~F.col("held_out")), unigram, states, rounds)

    def run(batches):
        for batch in batches:
            found = [log_likelihoods(model, s) for s in _sequences(batch.column("symbols"), 500_000)]
            keep = [f.name for f in batch.schema if f.name != "symbols"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(np.concatenate(found) if found else np.zeros(0))], names=[*keep, "log_symbols"])
    passing = ["rid", "doc_id", "held_out", "n_tokens", "known", "log_counts", "log_class"]
    scored = coded.select(*passing, "symbols").mapInArrow(run, ENCODED.split(", symbols")[0] + ", log_symbols double")
    rare = coded.select("rid", F.explode("rare").alias("r")).select("rid", "r.word", "r.n")
    c = F.coalesce(F.col("c"), F.lit(0))
    joined = rare.join(counts.select("word", F.col("n").alias("c")), "word", "left")
    rare_sums = joined.groupBy("rid").agg(F.sum(F.col("n") * F.log10(c + F.lit(0.5))).alias("rare_log"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    norm = float(np.log10(n_all + 0.5 * (n_distinct + 1)))
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return scored.join(rare_sums, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("log_counts") + rare_log - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("log_symbols") + F.col("log_class") + rare_log).alias("score"))
