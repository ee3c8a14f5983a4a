"""Operator 9, language ID: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of every training text into a fixed number of buckets for each
language, in the tasks, and Spark sums them.  The matrix of log probabilities (buckets x
languages, at most `most_cells` numbers: with very many languages buckets are folded) goes to
the tasks, which score whole batches of texts by summing the rows of their n-grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sublens.llm.common import LOWER, text_slices

SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"
ORDERS = (2, 3, 4)
BUCKETS = 1 << 15
UNKNOWN = "und"


def _grams(texts: list[str], buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each n-gram order the bucket of the n-gram at each byte (`buckets` where it would cross
    into the next text), and the first byte of each text.  A space ends each text."""
    values = [t.encode() for t in texts]
    data = LOWER[np.frombuffer(b" ".join([*values, b""]), dtype=np.uint8)].astype(np.uint32)
    bounds = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum([len(v) + 1 for v in values], out=bounds[1:])
    out = []
    shift = np.uint32(32 - int(np.log2(buckets)))
    code = data.copy()
    for n in range(2, max(ORDERS) + 1):
        code[:len(data) - n + 1] = code[:len(data) - n + 1] << np.uint32(8) | data[n - 1:]
        if n in ORDERS:
            bucket = (((code ^ np.uint32(0x5BD1 * n)) * np.uint32(0x9E3779B1)) >> shift).astype(np.int32)
            for k in range(1, n):
                bucket[np.maximum(bounds[1:] - k, bounds[:-1])] = buckets
            out.append(bucket)
    return out, bounds[:-1]


def gram_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """lang, bucket, n over rows (lang, text); bucket -1 counts the texts."""
    def run(batches):
        held: dict[str, np.ndarray] = {}

        def flush():
            for lang, counts in held.items():
                some = np.flatnonzero(counts)
                yield pa.record_batch([pa.array([lang] * len(some)), pa.array(some.astype(np.int32) - 1), pa.array(counts[some])], names=["lang", "bucket", "n"])
            held.clear()
        for whole in batches:
            for batch in text_slices(whole, most=500_000):
                langs = batch.column("lang").to_pylist()
                grams, first = _grams(batch.column("text").to_pylist(), buckets)
                names = sorted(set(langs))
                index = np.searchsorted(names, langs)
                of_byte = np.repeat(index, np.diff(np.append(first, len(grams[0]))))
                for k, lang in enumerate(names):
                    counts = held.setdefault(lang, np.zeros(buckets + 1, dtype=np.int64))
                    counts[0] += int((index == k).sum())
                    mine = slice(None) if len(names) == 1 else of_byte == k
                    for bucket in grams:
                        counts[1:] += np.bincount(bucket[mine], minlength=buckets + 1)[:buckets]
                    if len(held) > 128:
                        yield from flush()
        yield from flush()
    return docs.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, buckets: int = BUCKETS, most_cells: int = 1 << 23, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """(languages in order, log probabilities: row per bucket, then one for crossings (0), then the priors)."""
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    n_langs = labelled.select("lang").distinct().count()
    folded = buckets
    while n_langs * folded > most_cells:
        if folded <= 256:
            raise ValueError(f"{n_langs} languages need more than {most_cells} cells; raise most_cells")
        folded //= 2
    counted = gram_counts(labelled, buckets)
    if folded < buckets:
        bucket = F.when(F.col("bucket") < 0, -1).otherwise(F.floor(F.col("bucket") / (buckets // folded))).cast("int")
        counted = counted.groupBy("lang", bucket.alias("bucket")).agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # at most languages x (folded + 1) rows
    langs = sorted(set(table.column("lang").to_pylist()))
    counts = np.zeros((folded + 1, len(langs)))
    at = np.searchsorted(langs, table.column("lang").to_pylist()) if langs else np.zeros(0, dtype=int)
    counts[table.column("bucket").to_numpy() + 1, at] = table.column("n").to_numpy()
    model = np.zeros((folded + 2, len(langs)), dtype=np.float32)
    model[:folded] = np.log((counts[1:] + smoothing) / (counts[1:].sum(0) + smoothing * folded))
    model[folded + 1] = np.log(counts[0] / counts[0].sum()) if langs else 0
    return langs, model


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], passing: str) -> DataFrame:
    """lang_pred and score (posterior) after the columns `passing` of rows with `text`."""
    langs, matrix = model
    folded = len(matrix) - 2

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, most=500_000):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                known = [bool(langs) and any(map(str.isalpha, t)) for t in texts]
                names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if any(known):
                    grams, first = _grams(texts, folded)
                    total = np.zeros((len(texts), len(langs))) + matrix[folded + 1]
                    for k in range(len(langs)):
                        column = matrix[:, k].copy()
                        for bucket in grams:
                            total[:, k] += np.add.reduceat(column[bucket], first, dtype=np.float64)
                    best = total.argmax(axis=1)  # ties: the first language in order
                    posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                    for i in np.flatnonzero(known).tolist():
                        names[i], scores[i] = langs[best[i]], posterior[i]
                keep = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "text"]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(names, pa.string()), pa.array(scores)], names=[*[f.name for f in batch.schema if f.name != "text"], "lang_pred", "score"])
    return docs.mapInArrow(run, f"{passing}, lang_pred string, score double")


def language_id(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learns from rows that aren't held out.

    Trains when called.  `und` with score 0 where the text is null or has no letter, or nothing
    could be learned; ties go to the first language in alphabetical order.  Rows without text or
    language teach nothing.  Ids may be null or repeat; other columns are ignored; an empty
    table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = train(rows.where(~F.col("held_out")).select("lang", "text"), buckets)
    return predict(rows.drop("lang"), model, "doc_id bigint, held_out boolean")
