"""Operator 3, n-gram Jaccard join by chosen paths.

Texts are sets of five-word shingles.  In each run a set chooses one of its shingles by a random
order (the smallest under a hash) and goes to that shingle's bucket; sets that are alike choose
alike with a chance equal to their similarity.  Buckets with more than `small` sets are split by
a second choice, and again, up to `depth` choices; whatever stands in one bucket at the end is
compared pair by pair, large buckets in blocks of rows so that no task holds one whole.  Runs are
repeated until a pair at the threshold is met with probability `recall` even where every path is
as long as allowed.  Sets with equal content are one class and are compared once.

A pair counts in the first run that brings it together.  A comparison of the choices already
made (an estimate with an error chance below one in a million at the threshold) comes first; then the
sets of what is left are joined in and compared exactly.  Tasks return the number of links of
each row and one edge per row to the smallest of its group, never the pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sublens.llm.common import MIX_A, MIX_B, drop_scratch, mix, prefix_sums, span_hashes, text_slices, words, written
from sublens.llm.components import components

GRAM, THRESHOLD, RECALL, DEPTH, SMALL, BLOCK = 5, 0.8, 0.999999, 3, 256, 1024
SIGNED = "rid bigint, doc_id bigint, text_hash bigint, n int, digest binary, choices binary, shingles binary"
ROW = "key bigint, i int, j int, block int, run int, rep bigint, n int, choices binary, depths binary"


def runs_for(recall: float, threshold: float, depth: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** depth))


def shingle_sets(column: pa.Array, gram: int = GRAM) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text; texts with fewer words have one of all their
    words, texts without words none."""
    data, _, start, end, first = words(column)
    word = span_hashes(prefix_sums(data), start, end)
    rolled = word.copy()
    for k in range(1, gram):
        rolled[:len(word) - k] = rolled[:len(word) - k] * MIX_B + word[k:] if len(word) > k else rolled[:0]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= gram:
            s = np.sort(rolled[a:b - gram + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            whole = 0
            for w in word[a:b].tolist():
                whole = (whole * int(MIX_B) + w) & 0xFFFFFFFFFFFFFFFF
            out.append(mix(np.array([whole], dtype=np.uint64)))
        else:
            out.append(word[:0])
    return out


def signed(docs: DataFrame, choices: int, gram: int) -> DataFrame:
    """Rows (doc_id, text, text_hash) as sets: size, digest, chosen shingles (32 bits of each), shingles (32 bits)."""
    factors = mix(np.arange(1, choices + 1, dtype=np.uint64) * MIX_A) | np.uint64(1)

    def run(batches):
        task, k = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in text_slices(whole, most=500_000):
                sets = shingle_sets(batch.column("text"), gram)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                chosen = np.zeros((len(sets), choices), dtype="<u4")
                some = np.flatnonzero(sizes)
                if len(some):
                    flat, first = np.concatenate(sets), (np.cumsum(sizes) - sizes)[some]
                    for c in range(choices):
                        chosen[some, c] = np.minimum.reduceat(flat * factors[c], first) >> np.uint64(32)
                rid = (task << 33) + k + np.arange(len(sets))
                k += len(sets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid), batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes.astype(np.int32)),
                     pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([c.tobytes() for c in chosen], pa.binary()),
                     pa.array([np.unique((s >> np.uint64(32)).astype("<u4")).tobytes() for s in sets], pa.binary())],
                    names=[c.split()[0] for c in SIGNED.split(", ")])
    return docs.mapInArrow(run, SIGNED)


def _paths(reps: DataFrame, runs: int, depth: int) -> DataFrame:
    """rep, run, and the names p1.. of its paths of one choice, two choices, ..."""
    names = [f"p{d}" for d in range(1, depth + 1)]

    def run(batches):
        for batch in batches:
            rep = batch.column("rep").to_numpy()
            chosen = np.frombuffer(b"".join(batch.column("choices").to_pylist()), dtype="<u4").reshape(len(rep), runs, depth).astype(np.uint64)
            name = np.broadcast_to(mix(np.arange(runs, dtype=np.uint64) + MIX_B), (len(rep), runs))
            columns = []
            for d in range(depth):
                name = mix(name * MIX_A + chosen[:, :, d])
                columns.append(pa.array(name.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rep, runs)), pa.array(np.tile(np.arange(runs, dtype=np.int32), len(rep))), *columns], names=["rep", "run", *names])
    return reps.select("rep", "choices").mapInArrow(run, "rep bigint, run int, " + ", ".join(f"{c} bigint" for c in names))


def _buckets(reps: DataFrame, runs: int, depth: int, small: int) -> tuple[DataFrame, list[DataFrame]]:
    """(rep, run, key, depth, members: the bucket with more than one set that each path ends in;
    the scratch tables made on the way)."""
    alive, out, held = _paths(reps, runs, depth), None, []
    for d in range(1, depth + 1):
        shared = alive.groupBy(f"p{d}").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        alive = written(alive.drop("members").join(shared, f"p{d}"), f"paths{d}")
        held.append(alive)
        ended = alive.where(F.lit(d == depth) | (F.col("members") <= small)).select("rep", "run", F.col(f"p{d}").alias("key"), F.lit(d).alias("depth"), "members")
        out = ended if out is None else out.unionByName(ended)
        alive = alive.where(F.col("members") > small)
    return written(out, "buckets"), held


def _candidates(group: np.ndarray, sides: np.ndarray, run: np.ndarray, n: np.ndarray, chosen: np.ndarray, depths: np.ndarray, threshold: float):
    """Pairs (a, b) of rows of one group, of different blocks where the group joins two, whose
    sizes allow the threshold, that no earlier run brought together and whose choices agree enough."""
    total, runs, depth = chosen.shape
    mean = runs * depth * threshold
    least = math.floor(mean - 5.2 * math.sqrt(mean * (1 - threshold)))
    found_a, found_b = [], []
    at = np.arange(total)
    step = 0
    while len(at):
        step += 1
        at = at[at + step < total]
        at = at[group[at] == group[at + step]]
        a, b = at, at + step
        fits = (sides[a] < 0) | (sides[a] != sides[b])
        fits &= np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b])
        a, b = a[fits], b[fits]
        for k in range(0, len(a), 20_000):
            x, y = a[k:k + 20_000], b[k:k + 20_000]
            same = chosen[x] == chosen[y]
            enough = same.reshape(len(x), -1).sum(axis=1) >= least
            x, y, same = x[enough], y[enough], same[enough]
            if len(x):
                along = np.logical_and.accumulate(same, axis=2)
                ends = depths[x]
                met = (ends == depths[y]) & (ends > 0) & np.take_along_axis(along, np.maximum(ends, 1)[:, :, None].astype(np.int64) - 1, axis=2)[:, :, 0]
                new = met.argmax(axis=1) == run[x]
                found_a.append(x[new])
                found_b.append(y[new])
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (none, none)


def _groups(batches, sized: str | None, most: int):
    """Tables of whole groups (key, i, j) from sorted rows: about `most` rows or 64 MB of `sized` at a time."""
    held, rows, size = [], 0, 0
    for batch in batches:
        for a in range(0, batch.num_rows, 2000):
            part = batch.slice(a, 2000)
            held.append(part)
            rows += part.num_rows
            size += part.column(sized).nbytes if sized else 0
            if rows >= most or size > 64_000_000:
                table = pa.Table.from_batches(held)
                names = [table.column(c).to_numpy() for c in ("key", "i", "j")]
                cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0))
                if len(cut):
                    yield table.slice(0, cut[-1] + 1)
                    held = table.slice(cut[-1] + 1).to_batches()
                    rows = sum(b.num_rows for b in held)
                    size = sum(b.column(sized).nbytes for b in held) if sized else 0
    if held:
        yield pa.Table.from_batches(held)


def _arrays(table: pa.Table, runs: int, depth: int):
    key, i, j, block, run, n = (table.column(c).to_numpy() for c in ("key", "i", "j", "block", "run", "n"))
    new = np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
    chosen = np.frombuffer(b"".join(table.column("choices").to_pylist()), dtype="<u4").reshape(len(key), runs, depth)
    depths = np.frombuffer(b"".join(table.column("depths").to_pylist()), dtype=np.uint8).reshape(len(key), runs)
    return np.cumsum(new), np.where(i == j, -1, block), run, n, chosen, depths


def _exact(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair's similarity reaches the threshold."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    if len(a) <= 64:
        common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist())], dtype=np.int64)
    else:
        flat = np.concatenate(sets)
        order = np.argsort(flat)
        owner = np.repeat(np.arange(len(sets)), n)[order]
        value = flat[order]
        new = np.append(True, value[1:] != value[:-1])
        place, count = np.cumsum(new) - 1, np.diff(np.append(np.flatnonzero(new), len(value)))
        shared = count > 1  # what one set alone has cannot be common
        keep = shared[place]
        column, owner = (np.cumsum(shared) - 1)[place[keep]], owner[keep]
        total = np.zeros((len(sets), len(sets)), dtype=np.float32)
        width = max(1, 8_000_000 // max(1, len(sets)))
        cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
        for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
            part = np.zeros((len(sets), width), dtype=np.float32)
            part[owner[x:y], column[x:y] - k * width] = 1
            total += part @ part.T
        common = total[a, b].astype(np.int64)
    return common >= threshold * (n[a] + n[b] - common) - 1e-9


def join(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, recall: float = RECALL, depth: int = DEPTH, small: int = SMALL, block: int = BLOCK,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, text_hash, class_id, copy_id, n_links, first.

    class_id: smallest id of the rows linked directly or through others; copy_id: smallest id of
    the rows with the same shingles; n_links: how many other classes of copies are similar to the
    row's own at the threshold; first: whether this row stands for its class (one row does).
    text_hash: xxhash64 of the text, to join back on where ids repeat.  Texts without words, null
    ones among them, are copies of each other.  Ids may be null (smallest ids ignore them) or
    repeat; other columns are ignored; an empty table gives an empty result.  Runs when called
    (tables between steps are written to the shared scratch folder).
    """
    spark = docs.sparkSession
    runs = runs_for(recall, threshold, depth)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sets = written(signed(rows, runs * depth, gram), "sets")
    slim = sets.select("rid", "doc_id", "text_hash", "n", "digest", "choices")
    reps = written(slim.groupBy("digest").agg(F.min(F.struct("rid", "n", "choices")).alias("r")).select("digest", F.col("r.rid").alias("rep"), "r.n", "r.choices"), "classes")
    buckets, held = _buckets(reps.where("n > 0"), runs, depth, small)
    ends = buckets.groupBy("rep").agg(F.collect_list(F.struct("run", "depth")).alias("ends"))  # `runs` entries at most

    blocks = F.ceil(F.col("members") / block).cast("int")
    laid = buckets.drop("depth").join(reps.select("rep", "n", "choices"), "rep").join(ends, "rep").withColumn("blocks", blocks)
    laid = laid.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    laid = laid.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "run", "rep", "n", "choices", "ends")
    dealt = laid.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def encoded(batches):  # the depth at which each run ended for this row, one byte a run
        for batch in batches:
            depths = np.zeros((batch.num_rows, runs), dtype=np.uint8)
            for k, found in enumerate(batch.column("ends").to_pylist()):
                for e in found:
                    depths[k, e["run"]] = e["depth"]
            yield batch.drop_columns(["ends"]).append_column("depths", pa.array([d.tobytes() for d in depths], pa.binary()))

    def screen(batches):
        for table in _groups(encoded(batches), None, 20_000):
            a, b = _candidates(*_arrays(table, runs, depth), threshold)
            yield from table.take(np.unique(np.concatenate((a, b)))).to_batches()

    left = dealt.mapInArrow(screen, ROW)
    with_sets = left.join(sets.select(F.col("rid").alias("rep"), "shingles"), "rep").select(*[c.split()[0] for c in ROW.split(", ")], "shingles")

    def compare(batches):
        for table in _groups(batches, "shingles", 5_000):
            group, *rest = _arrays(table, runs, depth)
            a, b = _candidates(group, *rest, threshold)
            shingles = [np.frombuffer(s, dtype="<u4") for s in table.column("shingles").to_pylist()]
            linked = np.zeros(len(a), dtype=bool)
            by = np.argsort(group[a], kind="stable")
            cuts = np.append(np.flatnonzero(np.append(True, np.diff(group[a[by]]) > 0)), len(by)) if len(by) else np.zeros(1, dtype=int)
            for x, y in zip(cuts, cuts[1:]):
                pairs = by[x:y]
                members, place = np.unique(np.concatenate((a[pairs], b[pairs])), return_inverse=True)
                linked[pairs] = _exact([shingles[m] for m in members.tolist()], place[:len(pairs)], place[len(pairs):], threshold)
            a, b = a[linked], b[linked]
            links = np.bincount(np.concatenate((a, b)), minlength=len(group))
            rep = table.column("rep").to_numpy()
            least = rep.copy()
            while True:
                before = least.copy()
                np.minimum.at(least, a, before[b])
                np.minimum.at(least, b, before[a])
                if (least == before).all():
                    break
            some = np.flatnonzero(links)
            yield pa.record_batch([pa.array(rep[some]), pa.array(links[some]), pa.array(least[some])], names=["rep", "links", "least"])

    found = written(with_sets.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, "rep bigint, links bigint, least bigint"), "links")
    near = components(found.select(F.col("rep").alias("u"), F.col("least").alias("v")), "linked").select(F.col("u").alias("rep"), F.col("v").alias("least"))
    links = found.groupBy("rep").agg(F.sum("links").alias("n_links"))
    classes = reps.select("digest", "rep").join(near, "rep", "left").join(links, "rep", "left").select("digest", F.coalesce("least", "rep").alias("least"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    ids = slim.groupBy("digest").agg(F.min("doc_id").alias("copy_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("top"))
    classes = classes.join(ids, "digest")
    whole = classes.groupBy("least").agg(F.min("copy_id").alias("class_id"), F.min("top").alias("top")).select("least", "class_id", F.col("top.rid").alias("first_rid"))
    members = slim.select("rid", "doc_id", "text_hash", "digest").join(classes.drop("top"), "digest").join(whole, "least")
    out = written(members.select("doc_id", "text_hash", "class_id", "copy_id", "n_links", (F.col("rid") == F.col("first_rid")).alias("first")), "joined")
    for table in (sets, reps, buckets, found, *held):
        drop_scratch(spark, table)
    return out
