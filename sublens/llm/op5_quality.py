"""Operator 5, quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its hashed features: words, pairs of successive
words (a repeated word gives one feature whatever the word) and character n-grams, each of
these kinds having the same weight in the mean.  A softmax over the mean gives the label.  Vectors and output layer are trained together by stochastic
gradient descent in numpy on a bounded sample of labelled rows (`per_label` of each label, the
smallest by a hash of the id); features of the sample are made in the tasks and reach the driver
a partition at a time, where they lie in a mapped file instead of memory.  Since both the mean
and the output layer are linear, scoring sums one number per feature.
"""

from __future__ import annotations

import tempfile
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from sublens.llm.common import MIX_A, MIX_B, drop_scratch, mix, prefix_sums, span_hashes, text_slices, words, written

SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"
BUCKETS, DIM = 1 << 16, 8
ORDERS = (3, 4)
PER_LABEL = 2500


def features(column: pa.Array, buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Streams of (bucket of each feature, first feature of each text (n+1)); gram features that
    would cross into the next text have bucket `buckets`, which counts for nothing."""
    data, bounds, start, end, first = words(column)
    shift = np.uint64(64 - int(np.log2(buckets)))
    word = span_hashes(prefix_sums(data), start, end)
    pair = mix(word[1:] * MIX_B + word[:-1]) if len(word) else word
    pair[word[1:] == word[:-1]] = MIX_A
    pair_bucket = np.append((pair >> shift).astype(np.int32), np.int32(buckets)) if len(word) else np.zeros(0, dtype=np.int32)
    some = first[1:] > first[:-1]
    pair_bucket[first[1:][some] - 1] = buckets
    out = [((mix(word) >> shift).astype(np.int32), first), (pair_bucket, first)]
    code, low = data.astype(np.uint32), np.uint32(32 - int(np.log2(buckets)))
    for n in range(2, max(ORDERS) + 1):
        code[:len(data) - n + 1] = code[:len(data) - n + 1] << np.uint32(8) | data[n - 1:]
        if n in ORDERS:
            bucket = (((code ^ np.uint32(0x27D4 * n)) * np.uint32(0x85EBCA6B)) >> low).astype(np.int32)
            for k in range(1, n):
                bucket[np.maximum(bounds[1:] - k, bounds[:-1])] = buckets
            out.append((bucket, bounds))
    return out


def _weights(held: DataFrame, buckets: int) -> DataFrame:
    """task and row (the text's place in the table), label, and each text's features as (buckets, shares) in binary."""
    def run(batches):
        task, k = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in text_slices(whole, most=500_000):
                streams = features(batch.column("text"), buckets)
                rows = []
                for i in range(batch.num_rows):
                    parts = [np.unique(x[x < buckets], return_counts=True) for x in (b[f[i]:f[i + 1]] for b, f in streams)]
                    found, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    share = np.concatenate([p[1] / max(1, p[1].sum()) for p in parts]) / len(parts)
                    rows.append((found.astype("<i4").tobytes(), np.bincount(place, weights=share, minlength=len(found)).astype("<f4").tobytes()))
                place = [pa.array([task] * len(rows), pa.int32()), pa.array(range(k, k + len(rows)), pa.int64())]
                k += len(rows)
                yield pa.RecordBatch.from_arrays([*place, batch.column("label"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["task", "row", "label", "buckets", "shares"])
    return held.mapInArrow(run, "task int, row bigint, label int, buckets binary, shares binary")


def _spooled(table: DataFrame) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """label, buckets and shares of the texts of a `_weights` table that have features, in order of
    the buckets' bytes, then of their place, whatever order the tasks ended in.

    Buckets and shares are views of a mapped temporary file: what the driver holds in memory does
    not grow with the texts, but for one partition on its way."""
    found, at = [], 0
    with tempfile.TemporaryFile() as spool:
        for r in table.toLocalIterator():
            if r["buckets"]:  # nothing is learned of empty texts
                spool.write(r["buckets"])
                spool.write(r["shares"])
                n = len(r["buckets"]) // 4
                found.append((r["task"], r["row"], r["label"], at, n))
                at += 2 * n
        spool.flush()
        flat = np.asarray(np.memmap(spool, dtype="<i4", mode="r")) if at else np.zeros(0, dtype="<i4")

    def compared(x, y):
        a, b = (flat[at:at + n].tobytes() for _, _, _, at, n in (x, y))
        return (a > b) - (a < b)
    found = sorted(sorted(found), key=cmp_to_key(compared))
    return (np.array([x[2] for x in found], dtype=np.int32), [flat[at:at + n] for _, _, _, at, n in found],
            [flat[at + n:at + 2 * n].view("<f4") for _, _, _, at, n in found])


def train(docs: DataFrame, known: DataFrame, buckets: int = BUCKETS, dim: int = DIM, per_label: int = PER_LABEL, epochs: int = 6, rate: float = 0.2, seed: int = 7) -> tuple[np.ndarray, float]:
    """(log odds of label 1 that each feature adds, the bias) from docs (doc_id, text) whose ids
    are in known (doc_id, label 0 or 1).  Only ids are shuffled to find the sample."""
    spark = docs.sparkSession
    ids = written(docs.select("doc_id").join(known, "doc_id"), "ids")  # joined once for all that follows
    totals = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        drop_scratch(spark, ids)
    if not totals:
        return np.zeros(buckets + 1), 0.0
    if len(totals) == 1:
        return np.zeros(buckets + 1), float(np.log((totals.get(1, 0) + 0.5) / (totals.get(0, 0) + 0.5)))
    picked = None
    for label in sorted(totals):
        some = ids.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        picked = some if picked is None else picked.unionByName(some)
    sample = docs.select("doc_id", "text").join(F.broadcast(picked.distinct()), "doc_id")  # per_label rows of each label at most
    table = written(_weights(sample.select("label", "text"), buckets), "features")  # made once, by all tasks
    label, index, share = _spooled(table)
    for made in (ids, table):
        drop_scratch(spark, made)
    if not len(label):
        return np.zeros(buckets + 1), 0.0
    have = {k: max(1, int((label == k).sum())) for k in totals}
    weight = np.array([totals[k] / have[k] for k in label.tolist()])
    weight /= weight.mean()
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    output, bias = np.zeros((dim, 2)), np.zeros(2)
    seen_v, seen_o, seen_b = np.full(buckets, 1e-8), np.full((dim, 2), 1e-8), np.full(2, 1e-8)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(label))
        for at in range(0, len(order), 32):
            rows = order[at:at + 32]
            lengths = [len(index[i]) for i in rows]
            which, part = np.concatenate([index[i] for i in rows]), np.concatenate([share[i] for i in rows]).astype(np.float64)
            owner = np.repeat(np.arange(len(rows)), lengths)
            mean = np.add.reduceat(vectors[which] * part[:, None], np.cumsum(lengths) - lengths)
            z = mean @ output + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), label[rows]] -= 1
            p *= weight[rows, None] / len(rows)
            back = p @ output.T
            grad_o, grad_b = mean.T @ p, p.sum(axis=0)
            found = np.flatnonzero(np.bincount(which, minlength=buckets))
            grad_v = np.stack([np.bincount(which, weights=back[owner, d] * part, minlength=buckets)[found] for d in range(dim)], axis=1)
            seen_v[found] += (grad_v ** 2).mean(axis=1)
            seen_o += grad_o ** 2
            seen_b += grad_b ** 2
            vectors[found] -= step * grad_v / np.sqrt(seen_v[found])[:, None]
            output -= step * grad_o / np.sqrt(seen_o)
            bias -= step * grad_b / np.sqrt(seen_b)
    return np.append(vectors @ (output[:, 1] - output[:, 0]), 0.0), float(bias[1] - bias[0])


def predict(docs: DataFrame, model: tuple[np.ndarray, float], passing: str) -> DataFrame:
    """score and predicted after the columns `passing` of rows with `text`."""
    odds, bias = model
    buckets = len(odds) - 1
    counted = np.append(np.ones(buckets), 0.0)

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, most=500_000):
                mean, streams = np.zeros(batch.num_rows), features(batch.column("text"), buckets)
                for bucket, first in streams:
                    some = first[1:] > first[:-1]
                    if some.any():
                        total, n = (np.add.reduceat(values[bucket], first[:-1][some]) for values in (odds, counted))
                        mean[some] += total / np.maximum(n, 1) / len(streams)
                score = 1 / (1 + np.exp(-np.clip(mean + bias, -500, 500)))
                keep = [(f.name, batch.column(i)) for i, f in enumerate(batch.schema) if f.name != "text"]
                yield pa.RecordBatch.from_arrays([*[c for _, c in keep], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*[k for k, _ in keep], "score", "predicted"])
    return docs.mapInArrow(run, f"{passing}, score double, predicted int")


def known_labels(labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """doc_id, label: of several labels of an id the majority counts (ties: 1); null ids and
    labels other than 0 and 1 are ignored."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull())
    return usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))


def quality(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, held_out, score (of label 1), predicted for every row; learns from labelled rows
    that aren't held out.

    Trains when called.  A null text is empty and has no features: its score follows from the
    bias.  Without labels every score is 0.5; with one label alone, near it.  Ids may be null or
    repeat; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    model = train(rows.where(~F.col("held_out")), known_labels(labels, label_col), per_label=per_label)
    return predict(rows, model, "doc_id bigint, held_out boolean")
