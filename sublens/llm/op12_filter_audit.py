"""How five document filters overlap: exact Shapley shares and every order's step counts.

A document becomes a mask of the filters it fails; a part (a language) becomes the counts of its 32
masks, and from them the 32 coalition values: what a set of filters removes together.  Everything
else is read off those values.  The Shapley shares solve the constrained least squares problem they
are the solution of: among all share vectors that add up to what all five remove, the one nearest
to the coalition values under the Shapley kernel; its normal equations (with the multiplier of the
constraint) are solved in rationals, so nothing is rounded.  A step of an order removes the
difference of two neighbouring coalitions.

A: fewer than 100 words; B: 100 * distinct words < 80 * words; C: 100 * [A-Z] > 10 * code points;
D: one of #$%&*|; E: the text of a smaller doc_id, table-wide.

A null text is empty, a null lang the empty string.  Rows are documents, also those that repeat a
doc_id; equal ids are not smaller than each other, and a null id neither is smaller nor has a smaller one.
A document is good (toxic) if any label row of its id says 1.  An empty table gives no rows.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from itertools import permutations
from math import comb

from pyspark.sql import Column, DataFrame, Window, functions as F

FILTERS = "ABCDE"
FULL = (1 << len(FILTERS)) - 1
WORD_GAP = r"[\x20\x09-\x0D]+"
SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: the text fails A, B, C, D."""
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    upper = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [F.size(words) < 100, F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
             upper.cast("long") * 100 > F.char_length(text).cast("long") * 10, text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): at most 32 rows a part."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), text_mask(text).alias("mask"))
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # Rows of one id first, so that the copies of one text under its smallest id can be told from the others.
    by_id = rows.join(said, "doc_id", "left").groupBy("doc_id", "part", "same", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.count("*").alias("n"))
    # A text with copies in any number is then a row per part and label: what its rows share, counted in the tasks before the shuffle.
    kinds = by_id.groupBy("same", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("same"))
    cleared = F.col("no_id") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    halves = F.explode(F.array(F.struct(F.col("mask"), F.col("cleared").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("cleared")).alias("n"))))
    return kinds.withColumn("first", first).withColumn("cleared", cleared).select("part", "good", "toxic", halves.alias("half")).groupBy("part", F.col("half.mask").alias("mask")).agg(
        F.sum("half.n").alias("n"), F.sum(F.col("half.n") * F.col("good")).alias("good"), F.sum(F.col("half.n") * F.col("toxic")).alias("toxic"))


def coalition_values(counts: list[int]) -> list[int]:
    """For each set of filters the number of documents that at least one of them fails, from the
    counts of each mask: all but those whose mask avoids the set."""
    inside = list(counts)
    for bit in range(len(FILTERS)):  # sums over subsets
        for mask in range(len(inside)):
            if mask >> bit & 1:
                inside[mask] += inside[mask ^ 1 << bit]
    return [inside[FULL] - inside[FULL ^ mask] for mask in range(len(inside))]


@cache
def kernel(players: int) -> tuple[tuple[int, Fraction], ...]:
    """(coalition, Shapley kernel weight) of all but the empty and the full coalition."""
    return tuple((s, Fraction(players - 1, comb(players, k) * k * (players - k))) for s in range(1, (1 << players) - 1) if (k := s.bit_count()))


def shapley(values: list[int], players: int = len(FILTERS)) -> list[Fraction]:
    """Shares of the players in the full coalition's value: the minimum of the kernel-weighted
    squares of (value of S - shares in S) under sum of shares = value of all - value of none."""
    size = players + 1
    system = [[Fraction(0)] * (size + 1) for _ in range(size)]  # normal equations, the multiplier last
    for s, weight in kernel(players):
        inside = [i for i in range(players) if s >> i & 1]
        for i in inside:
            for j in inside:
                system[i][j] += weight
            system[i][size] += weight * (values[s] - values[0])
    for i in range(players):
        system[i][players] = system[players][i] = Fraction(1)
    system[players][size] = Fraction(values[-1] - values[0])
    for column in range(size):
        pivot = next(r for r in range(column, size) if system[r][column])
        system[column], system[pivot] = system[pivot], system[column]
        system[column] = [x / system[column][column] for x in system[column]]
        for r in range(size):
            if r != column and (factor := system[r][column]):
                system[r] = [x - factor * y for x, y in zip(system[r], system[column])]
    return [system[i][size] for i in range(players)]


def part_rows(part: str, counts: dict[int, tuple[int, int, int]]) -> Iterator[tuple]:
    """The rows of one part from its mask counts (n, good, toxic): every order, every step."""
    n, good, toxic = ([counts.get(m, (0, 0, 0))[k] for m in range(FULL + 1)] for k in range(3))
    total, removed, good_lost, toxic_lost = sum(n), coalition_values(n), coalition_values(good), coalition_values(toxic)
    orders = list(permutations(range(len(FILTERS))))
    share = [s * len(orders) for s in shapley(removed)]
    assert all(s.denominator == 1 for s in share)  # a share is a mean over the orders
    for order in orders:
        name, before = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            gone = removed[after] - removed[before]
            yield (part, name, step, total - removed[after], gone, removed[1 << f] - gone, removed[FULL] - removed[FULL ^ 1 << f],
                   good_lost[after] - good_lost[before], toxic_lost[after] - toxic_lost[before], int(share[f]))
            before = after


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """600 rows a part: 120 orders of 5 steps."""
    def run(group):
        import pandas as pd
        counts = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(group["mask"], group["n"], group["good"], group["toxic"])}
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pd.DataFrame(list(part_rows(group["part"].iloc[0], counts)), columns=names)
    return mask_counts(docs, labels).groupBy("part").applyInPandas(run, SCHEMA)


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
f AS (SELECT w.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
              100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
              regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > least, false)] AS fails
      FROM w LEFT JOIN said ON w.doc_id = said.doc_id),
masks AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e
           WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT o, substr('ABCDE', o[1], 1) || substr('ABCDE', o[2], 1) || substr('ABCDE', o[3], 1) || substr('ABCDE', o[4], 1)
                 || substr('ABCDE', o[5], 1) AS filter_order, i AS step, o[i] AS f FROM orders, letters),
hits AS (SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS here,
                (step > 1 AND fails[o[1]]) OR (step > 2 AND fails[o[2]]) OR (step > 3 AND fails[o[3]]) OR (step > 4 AND fails[o[4]]) AS before,
                fails[1]::INT + fails[2]::INT + fails[3]::INT + fails[4]::INT + fails[5]::INT AS n_fails FROM steps, masks),
rows_ AS (SELECT part, filter_order, step, f,
        sum(CASE WHEN NOT here AND NOT before THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND NOT before THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN here AND before THEN n ELSE 0 END) AS redundant, sum(CASE WHEN here AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN here AND NOT before THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND NOT before THEN toxic ELSE 0 END) AS toxic_lost
      FROM hits GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM rows_
"""
