"""How the sources of a language differ in their terms: hash-consed segment trees.

Terms of at least `least_docs` documents of a language are dealt by hash to blocks of about
`block_rows` (source, term) counts, so a task holds one block of one language.  Inside a block the
terms are numbered by falling total and every group's counts are the leaves of a segment tree over
those numbers.  Trees are hash-consed bottom up: a node is named by its two children's names, so
equal count subtrees of any groups are one node, and the empty subtree of each level is node 0 and is never
stored.  Two groups are priced by walking down their roots together: at each level equal (node,
node) pairs are merged with their multiplicities before they are opened, so a pair is opened and
its leaves priced once however often it occurs.  Block sums are added up per pair of groups.

p = 1 + floor(10^9 (count + 1) / (N + V)) for a term of a group with N kept occurrences in a
language of V kept terms; a term (or pair) is worth f = floor((p - q)^2 / q).  Python integers
price the distinct leaf pairs, so nothing is rounded.

Null text, lang and source are the empty string.  A row is a document, also where rows repeat.
Groups without a kept term take part with counts of 0; a language without kept terms gives value 0
for each pair.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

SCALE = 10**9
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")  # of UTF-8: letters and every byte of other characters
COUNTED = "lang string, source string, term string, n long, docs long"
PRICED = "lang string, source string, part string, item string, value long"
HELD = 80_000_000  # bytes of distinct (lang, source, term) that a task holds, as estimated, before it passes them on


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents holding the term."""
    def run(batches):
        import pyarrow as pa
        have: dict = defaultdict(dict)
        size = 0

        def flush():
            for (lang, source), terms in have.items():
                n = len(terms)
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array([t.decode() for t in terms], pa.string()),
                    pa.array([x[0] for x in terms.values()], pa.int64()), pa.array([x[1] for x in terms.values()], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])
            have.clear()
        for batch in batches:
            lang, source, text = (batch.column(i).to_pylist() for i in range(3))
            for group, t in zip(zip(lang, source), text):
                terms = have[group]
                for term, n in Counter(TERM.findall(t.encode().lower())).items():
                    if (old := terms.get(term)) is None:
                        terms[term] = [n, 1]
                        size += len(term) + 200
                    else:
                        old[0] += n
                        old[1] += 1
                if size > HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return rows.mapInArrow(run, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class Forest:
    """The hash-consed segment trees of several groups over the leaves 0 to n_leaves - 1, from the
    counts that aren't 0: (group, leaf, count), each (group, leaf) once."""

    def __init__(self, group: np.ndarray, leaf: np.ndarray, count: np.ndarray, n_groups: int, n_leaves: int):
        self.depth = max(0, int(n_leaves - 1).bit_length())
        self.padding = (1 << self.depth) - n_leaves
        self.counts, node = np.unique(np.concatenate(([0], count)), return_inverse=True)  # leaf node k holds counts[k]; 0 is empty
        node = node[1:]
        order = np.lexsort((leaf, group))
        group, leaf, node = group[order], leaf[order], node[order]
        self.children: list[tuple[np.ndarray, np.ndarray]] = []  # per level from the leaves: (left, right) of each node
        for _ in range(self.depth):
            parent = leaf >> 1
            first = np.ones(len(leaf), dtype=bool)
            first[1:] = (group[1:] != group[:-1]) | (parent[1:] != parent[:-1])
            at = np.cumsum(first) - 1
            two = np.zeros((2, int(first.sum())), dtype=np.int64)
            two[leaf & 1, at] = node
            code = two[0] << 32 | two[1]
            known, name = np.unique(np.concatenate(([0], code)), return_inverse=True)
            self.children.append((known >> 32, known & 0xFFFFFFFF))
            group, leaf, node = group[first], parent[first], name[1:]
        self.roots = np.zeros(n_groups, dtype=np.int64)
        self.roots[group] = node

    def leaf_pairs(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count in a, count in b, number of leaves), each pair of counts once."""
        left, right, times = self.roots[[a]], self.roots[[b]], np.ones(1, dtype=np.int64)
        for lower, upper in reversed(self.children):
            code = np.concatenate((lower[left] << 32 | lower[right], upper[left] << 32 | upper[right]))
            pairs, at = np.unique(code, return_inverse=True)
            summed = np.zeros(len(pairs), dtype=np.int64)
            np.add.at(summed, at, np.concatenate((times, times)))
            left, right, times = pairs >> 32, pairs & 0xFFFFFFFF, summed
        if self.padding:
            times = times - self.padding * ((left == 0) & (right == 0))
        return self.counts[left], self.counts[right], times


def probabilities(counts: np.ndarray, total: int, terms: int) -> list[int]:
    return [1 + SCALE * (c + 1) // (total + terms) for c in counts.tolist()]


def worth(p: int, q: int) -> int:
    return (p - q) * (p - q) // q


def price_block(lang: str, sources: list[str], totals: list[int], source: np.ndarray, term: list[str], count: np.ndarray,
                n_terms: int, lang_total: int, top: int) -> Iterator[tuple]:
    """Rows of PRICED of one block: sums of ordered pairs of sources, and the `top` best terms of
    each source.  `source` indexes `sources`; `totals` are the sources' kept occurrences."""
    names = sorted(set(term))
    index = {name: i for i, name in enumerate(names)}
    at = np.fromiter((index[t] for t in term), np.int64, len(term))
    whole = np.zeros(len(names), dtype=np.int64)
    np.add.at(whole, at, count)
    number = np.empty(len(names), dtype=np.int64)
    number[np.lexsort((np.arange(len(names)), -whole))] = np.arange(len(names))
    k = len(sources)  # group k is the language itself
    forest = Forest(np.concatenate((source, np.full(len(names), k))), np.concatenate((number[at], number)),
                    np.concatenate((count, whole)), k + 1, len(names))
    for a in range(k):
        for b in range(a + 1, k):
            ca, cb, times = forest.leaf_pairs(a, b)
            p, q = probabilities(ca, totals[a], n_terms), probabilities(cb, totals[b], n_terms)
            yield lang, sources[a], "pair", sources[b], sum(t * worth(x, y) for x, y, t in zip(p, q, times.tolist()))
            yield lang, sources[b], "pair", sources[a], sum(t * worth(y, x) for x, y, t in zip(p, q, times.tolist()))
    order = np.argsort(source, kind="stable")
    bounds = np.searchsorted(source[order], np.arange(k + 1))
    for a in range(k):
        mine = order[bounds[a]:bounds[a + 1]]
        if not len(mine):
            continue
        ca, cl, _ = forest.leaf_pairs(a, k)
        value = {(x, y): worth(p, q) if p > q else -1 for x, y, p, q in zip(
            ca.tolist(), cl.tolist(), probabilities(ca, totals[a], n_terms), probabilities(cl, lang_total, n_terms))}
        found = [(-v, names[at[i]].encode()) for i in mine.tolist() if (v := value[int(count[i]), int(whole[at[i]])]) >= 0]
        for v, name in sorted(found)[:top]:
            yield lang, sources[a], "term", name.decode(), -v


def divergence(docs: DataFrame, least_docs: int = 3, top: int = 200, block_rows: int = 200_000) -> DataFrame:
    """lang, source, part, item, value, rank (see the module)."""
    from sublens.llm.common import written

    in_docs = F.sum("docs").over(Window.partitionBy("lang", "term"))
    counts = written(term_counts(docs).withColumn("in_docs", in_docs).where(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n"), "kept-terms")
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    per_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).groupBy("lang").agg(
        F.count("*").alias("n_terms"), F.sum("n").alias("lang_total"), F.ceil(F.sum("rows") / block_rows).cast("int").alias("blocks"))
    sources = written(groups.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(per_lang, "lang", "left"), "sources")
    langs = sources.groupBy("lang").agg(F.first("blocks").alias("blocks"))
    dealt = counts.join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "n")
    members = sources.where("blocks is not null").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.coalesce("total", F.lit(0)).alias("total"), "n_terms", "lang_total")

    def run(key, rows, here):
        import pandas as pd
        priced = []
        if len(rows):
            names = here["source"].tolist()
            index = {s: i for i, s in enumerate(names)}
            priced = list(price_block(key[0], names, [int(x) for x in here["total"]], rows["source"].map(index).to_numpy(np.int64), rows["term"].tolist(),
                                      rows["n"].to_numpy(np.int64), int(here["n_terms"].iloc[0]), int(here["lang_total"].iloc[0]), top))
        return pd.DataFrame(priced, columns=["lang", "source", "part", "item", "value"])

    priced = written(dealt.groupBy("lang", "block").cogroup(members.groupBy("lang", "block")).applyInPandas(run, PRICED), "priced")
    other = sources.select("lang", F.col("source").alias("item"))
    pairs = sources.select("lang", "source").join(other, "lang").where("source <> item").join(
        priced.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), ["lang", "source", "item"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = priced.where("part = 'term'").withColumn("rank", ranked).where(F.col("rank") <= top)
    return pairs.withColumn("rank", ranked).unionByName(best)


ORACLE_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
tokens AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM t),
kept AS (SELECT lang, term, count(*) AS n FROM tokens GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
cells AS (SELECT k.lang, source, k.term, count(*) AS n FROM tokens JOIN kept k ON tokens.lang = k.lang AND tokens.term = k.term GROUP BY ALL),
vocabulary AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups_ AS (SELECT DISTINCT lang, source FROM t),
totals AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM groups_ g LEFT JOIN cells c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                 CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (g.total + 1 * w.v) AS HUGEINT) AS p
          FROM totals g JOIN kept k ON g.lang = k.lang JOIN vocabulary w ON w.lang = g.lang
          LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
          FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
all_pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
              FROM groups_ a JOIN groups_ b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
priced AS (SELECT d.lang, d.source, d.term AS item, d.p, CAST(1 + (CAST(1000000000 AS HUGEINT) * (k.n + 1)) // (w.total + 1 * w.v) AS HUGEINT) AS q
           FROM dense d JOIN kept k ON k.lang = d.lang AND k.term = d.term JOIN vocabulary w ON w.lang = d.lang WHERE d.n > 0),
terms AS (SELECT lang, source, 'term' AS part, item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM priced WHERE p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
           FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
