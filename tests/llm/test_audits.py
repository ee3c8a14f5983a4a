"""Operators 11 to 13 against plain Python and DuckDB, on small tables with awkward rows."""
import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations, permutations
from math import factorial

import duckdb
import numpy as np
import pytest

from sublens.llm import op11_line_dedup, op12_filter_audit, op13_divergence

GIVEN = "doc_id bigint, text string, lang string, source string, key string, hash int, cell int, part int, n int, term int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, 3, 4, 5) for r in rows], GIVEN).repartition(3)


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def same_as_sql(name, sql, got, rows, labels=()):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INTEGER, toxic INTEGER)")
    for table, some in (("documents", rows), ("labels", labels)):
        for r in some:
            con.execute(f"INSERT INTO {table} VALUES ({','.join('?' * len(r))})", r)
    want = con.sql(sql)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in got.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key), name


@pytest.fixture(scope="module")
def line_rows():
    rng = random.Random(5)
    shared = ["  \t" + c * 38 + "éÀ" for c in "AbCdE"] + ["x" * 40, "y" * 39, "Z" * 41 + "\x0b\x0c\r"]
    rows = []
    for i in range(60):
        lines = [rng.choice(shared + ["short", "", " "]) if rng.random() < 0.6 else str(rng.random()) * 4 for _ in range(rng.randint(1, 9))]
        rows.append((i, "\n".join(s.upper() if rng.random() < 0.3 else s for s in lines), "en", "s"))
    return [*rows, (None, None, None, None), (3, "", "en", "s"), (3, rows[3][1], "en", "s"), (None, rows[4][1], "en", "s"), (100, "\n".join([shared[0]] * 4), "en", "s"),
            (101, "\n" * 3, "en", "s"), (102, "w" * 200_000 + "\n" + "\n".join([shared[5]] * 30_000), "en", "s")]


def line_dedup_by_hand(rows):
    key = lambda s: lowered(s.strip(" \t\n\x0b\x0c\r"))
    docs = [(r[0], r[1] or "") for r in rows]
    held = defaultdict(set)
    for d in docs:
        for s in d[1].split("\n"):
            if len(key(s)) >= 40:
                held[key(s)].add(d)
    keeper = {k: max((-1 if d[0] is None else d[0]) for d in v) for k, v in held.items() if len(v) >= 5}
    for i, text in docs:
        lines = text.split("\n")
        kept = [s for s in lines if keeper.get(key(s), -1 if i is None else i) == (-1 if i is None else i)]
        yield i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_line_dedup(spark, line_rows):
    want = Counter(line_dedup_by_hand(line_rows))
    docs = frame(spark, line_rows)
    assert Counter(tuple(r) for r in op11_line_dedup.digests(docs).collect()) == want
    # one range (no cell split), and so many that every cell is split by document
    for ranges in (1, 5000):
        found = op11_line_dedup.line_dedup(docs, ranges=ranges).collect()
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in found) == want
    same_as_sql("op11", op11_line_dedup.ORACLE_SQL, op11_line_dedup.digests(docs), [r[:4] for r in line_rows])
    assert op11_line_dedup.digests(docs.limit(0)).count() == 0


def test_line_dedup_bitmaps_are_runs_of_kept_lines(spark):
    line = "q" * 40
    rows = [(i, f"{line}\n{line}\nown {i}\n{line}", "en", "s") for i in range(5)]
    bitmaps = {r.doc_id: [tuple(x) for x in r.keep] for r in op11_line_dedup.keep_bitmaps(frame(spark, rows)).collect()}
    assert bitmaps == {i: [(2, 1), (4, -1)] for i in range(4)}
    assert {r.text for r in op11_line_dedup.line_dedup(frame(spark, rows)).where("doc_id < 4").collect()} == {f"own {i}" for i in range(4)}


@pytest.fixture(scope="module")
def audit_rows():
    rng = random.Random(6)
    texts = []
    for _ in range(50):
        words = [rng.choice("alpha beta Gamma DELTA épsilon zeta".split()) + str(rng.randint(0, 400)) * (rng.random() < 0.8) for _ in range(rng.choice([5, 99, 100, 140]))]
        texts.append(rng.choice([" ", "\n", " \t"]).join(words) + rng.choice(["", " #1", "|"]))
    rows = [(i, rng.choice(texts), rng.choice(["en", "de"]), "s") for i in range(120)]
    return [*rows, (None, rows[0][1], "en", "s"), (None, None, None, None), (7, rows[7][1], "en", "s"), (0, rows[7][1], "de", "s"), (500, "", "", "s"), (501, "A" * 40_000, "fr", "s")]


def fails_by_hand(rows):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, lang, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        yield lang or "", i, {f for f, yes in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                                                           bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t])) if yes}


def test_filter_audit(spark, audit_rows):
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 110)] + [(4, 1, 0), (None, 1, 1), (9999, 1, 1)]
    table = spark.createDataFrame([(i, int(q), int(t), "clash") for i, q, t in labels], "doc_id bigint, quality int, toxic int, lang string")
    got = op12_filter_audit.audit(frame(spark, audit_rows), table)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    marks = list(fails_by_hand(audit_rows))
    want, shares = {}, Counter()
    for part in {m[0] for m in marks}:
        for order in permutations("ABCDE"):
            left = [m for m in marks if m[0] == part]
            out = []
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[2]]
                left = [m for m in left if f not in m[2]]
                all_failing = [m for m in marks if m[0] == part and f in m[2]]
                want[part, "".join(order), step] = [len(left), len(gone), len(all_failing) - len(gone), sum(m[2] == {f} for m in all_failing),
                                                    sum(m[1] in good for m in gone), sum(m[1] in toxic for m in gone)]
                shares[part, f] += len(gone)
    found = {(r.part, r.filter_order, r.step): r for r in got.collect()}
    assert found.keys() == want.keys()
    for k, r in found.items():
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == [*want[k], shares[k[0], k[1][k[2] - 1]]]
    same_as_sql("op12", op12_filter_audit.ORACLE_SQL, got, [r[:4] for r in audit_rows], [(i, int(q), int(t)) for i, q, t in labels])
    assert op12_filter_audit.audit(frame(spark, audit_rows).limit(0), table).count() == 0
    assert op12_filter_audit.audit(frame(spark, audit_rows), table.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_least_squares_gives_the_shapley_values_of_any_game():
    rng = random.Random(1)
    values = [rng.randint(-50, 50) for _ in range(32)]
    for i, share in enumerate(op12_filter_audit.shapley(values)):
        want = Fraction(0)
        others = [j for j in range(5) if j != i]
        for k in range(5):
            for s in combinations(others, k):
                mask = sum(1 << j for j in s)
                want += Fraction(factorial(k) * factorial(4 - k), factorial(5)) * (values[mask | 1 << i] - values[mask])
        assert share == want


@pytest.fixture(scope="module")
def term_rows():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcÉßяあ") for _ in range(rng.randint(1, 3))) for _ in range(50)] + ["The", "tHE", "a1b", "x" * 20_000]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60))), rng.choice(["en", "de"]), rng.choice(["s1", "s2", "S3", "é"])) for i in range(80)]
    return [*rows, (None, None, None, None), (3, rows[3][1], "en", "s1"), (3, rows[3][1], "en", "s1"), (90, "", "en", "nothing"),
            (91, "once", "fr", "a"), (92, "again", "fr", "b"), (93, "0 1 2", None, "alone"), (94, "a\x00b\x7fc", "en", None)]


def divergence_by_hand(rows, top=200):
    count, in_docs = defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for _, text, lang, source in rows:
        lang, source, words = lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text or ""))
        groups[lang].add(source)
        count[lang, source].update(words)
        in_docs[lang].update(set(words))
    for lang, sources in groups.items():
        kept = sorted(t for t, n in in_docs[lang].items() if n >= 3)
        counts = {s: {t: count[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(c[t] for c in counts.values()) for t in kept}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        f = lambda x, y: (x - y) ** 2 // y
        for s in sources:
            pairs = sorted((-sum(f(p(counts[s])[t], p(counts[o])[t]) for t in kept), o.encode()) for o in sources - {s})
            terms = sorted((-f(p(counts[s])[t], p(whole)[t]), t.encode()) for t in kept if counts[s][t] and p(counts[s])[t] > p(whole)[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                for rank, (v, item) in enumerate(found, 1):
                    yield lang, s, part, item.decode(), -v, rank


def test_divergence(spark, term_rows):
    want = Counter(divergence_by_hand(term_rows))
    docs = frame(spark, term_rows)
    assert Counter(tuple(r) for r in op13_divergence.divergence(docs).collect()) == want
    assert Counter(tuple(r) for r in op13_divergence.divergence(docs, block_rows=7, top=5).collect()) == Counter(divergence_by_hand(term_rows, 5))
    same_as_sql("op13", op13_divergence.ORACLE_SQL, op13_divergence.divergence(docs), [r[:4] for r in term_rows])
    assert op13_divergence.divergence(docs.limit(0)).count() == 0


@pytest.mark.parametrize("leaves", [1, 2, 5, 64, 77])
def test_trees_share_equal_subtrees_and_price_every_leaf(leaves):
    rng = np.random.default_rng(leaves)
    dense = rng.integers(0, 3, (4, leaves)) * 10**12
    dense[3] = dense[0]
    group, leaf = np.nonzero(dense)
    forest = op13_divergence.Forest(group, leaf, dense[group, leaf], 5, leaves)
    assert forest.roots[0] == forest.roots[3] and forest.roots[4] == 0
    whole = np.vstack((dense, np.zeros(leaves, dtype=np.int64)))
    for a in range(5):
        for b in range(5):
            x, y, n = forest.leaf_pairs(a, b)
            assert {(i, j): k for i, j, k in zip(x.tolist(), y.tolist(), n.tolist()) if k} == Counter(zip(whole[a].tolist(), whole[b].tolist()))
