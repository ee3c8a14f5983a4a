"""Operators 1, 3, 5, 6, 7, 8, 9 and the pipeline against brute force, on small tables."""
import base64
import bz2
import gzip
import hashlib
import lzma
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sublens.llm import op1_hmm, op3_chosen_path, op5_quality, op6_secrets, op7_fingerprints, op8_neighbours, op9_language
from sublens.llm.common import remainder

TINY = "/root/testdata/sf0.001"
def never():
    return F.lit(False)


def make(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id bigint, text string, score string, rid int").repartition(3)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    return [prose(rng, rng.randint(1, 60)) for _ in range(60)] + ["", " \t", "the the the", "x" * 3000, prose(rng, 6000)]


@pytest.fixture
def docs(spark, texts):
    return make(spark, [*enumerate(texts), (None, None), (3, None), (3, texts[3]), (None, texts[4])])


def test_hmm_scores(spark, texts):
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in op1_hmm.score(rows, remainder(F.col("doc_id"), 5) == 1, rounds=1).collect()}
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"] for i, t in enumerate([*texts, None])}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    count = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        want = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(want, rel=1e-9) and r.score < 0
    assert op1_hmm.score(rows.limit(0), never(), rounds=1).count() == 0


def test_forward_and_expected_counts_match_enumeration():
    rng = np.random.default_rng(1)
    start, move, emit = rng.dirichlet([1, 1]), rng.dirichlet([1, 1], 2), rng.dirichlet([1] * 4, 2).T
    sequences = [np.array(s) for s in ([0, 1, 2], [3], [1, 1, 0, 2])]
    want, starts, moves = [], np.zeros(2), np.zeros((2, 2))
    for s in sequences:
        chance = {}
        for path in np.ndindex(*[2] * len(s)):
            p = start[path[0]] * emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= move[path[t - 1], path[t]] * emit[s[t], path[t]]
            chance[path] = p
        total = sum(chance.values())
        want.append(math.log10(total))
        for path, p in chance.items():
            starts[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / total
    assert op1_hmm.log_likelihoods((start, move, emit), sequences) == pytest.approx(want)
    got = op1_hmm.expected_counts((start, move, emit), sequences)
    assert got[0] == pytest.approx(starts) and got[1] == pytest.approx(moves)
    assert got[2].sum() == pytest.approx(8) and got[3] == pytest.approx(sum(want))


def near_texts():
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    out = []
    for _ in range(400):  # a large group of near copies of one text
        copy = list(base)
        copy[rng.randrange(120)] = f"v{rng.randrange(10_000)}"
        out.append(" ".join(copy))
    passage = " ".join(f"p{i}" for i in range(50))
    out += [passage + " " + prose(rng, 150) for _ in range(100)]  # a passage many share
    return out + out[:20] + ["one two", "one two", "", " ", "a b c d e"]


def test_join_against_brute_force(spark):
    texts = near_texts()
    got = {r.doc_id: r for r in op3_chosen_path.join(make(spark, list(enumerate(texts))), block=64, small=32).collect()}
    sets = {}
    for i, t in enumerate(texts):
        w = t.split()
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    distinct = {}
    for i, s in sets.items():
        distinct.setdefault(s, i)
    links, parent = Counter(), {i: i for i in distinct.values()}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for s, i in distinct.items():
        for u, j in distinct.items():
            if i < j and s and u and len(s & u) >= 0.8 * len(s | u):
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert {i: (got[i].copy_id, got[i].n_links, got[i].class_id) for i in sets} == {i: (distinct[s], links[distinct[s]], root(distinct[s])) for i, s in sets.items()}
    assert Counter(r.class_id for r in got.values() if r.first) == Counter({r.class_id for r in got.values()})


def test_join_edge_cases(spark, docs):
    rows = op3_chosen_path.join(docs).collect()
    assert len(rows) == docs.count()
    words = {r.text if r.text and r.text.strip() else "" for r in docs.collect()}  # wordless texts are copies of each other
    assert sum(r.first for r in rows) == len(words)
    assert op3_chosen_path.join(docs.limit(0)).count() == 0


def test_quality_learns_and_takes_edge_cases(spark, docs):
    rng = random.Random(8)
    rows = [(i, (f"junk%%% {prose(rng, 20)} %%%" if i % 3 == 0 else prose(rng, 24))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i, _ in rows] + [(None, 1), (0, None), (1, 7)], "doc_id bigint, quality int")
    got = op5_quality.quality(make(spark, rows), labels, remainder(F.col("doc_id"), 3) == 1).collect()
    assert np.mean([r.predicted == (r.doc_id % 3 != 0) for r in got if r.held_out]) > 0.8
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert op5_quality.quality(docs, labels, never()).count() == docs.count()
    assert {r.score for r in op5_quality.quality(docs, labels.limit(0), never()).collect()} == {0.5}
    assert op5_quality.quality(docs.limit(0), labels, never()).count() == 0


def test_quality_sample_stays_out_of_the_driver(spark):
    rng = np.random.default_rng(3)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz   ", dtype=np.uint8)
    rows = [(i, letters[rng.integers(0, len(letters), 12_000)].tobytes().decode()) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8).persist()
    sample = docs.withColumn("label", (F.col("doc_id") % 2).cast("int"))
    size = op5_quality._weights(sample.select("label", "text"), 1 << 16).agg(F.sum(F.length("buckets") + F.length("shares"))).first()[0]
    assert size > 80_000_000
    tracemalloc.start()
    op5_quality.train(docs, sample.select("doc_id", "label"), dim=1, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    docs.unpersist()
    assert peak < 0.75 * size  # copies of the sample took more than 1.5 times its size


def test_secret_layers(spark, docs):
    secret = 'password = "hunter2hunter2"'
    zipped = base64.b64encode(gzip.compress(secret.encode())).decode()
    url = "".join(f"%{b:02X}" for b in secret.encode())
    escaped = "".join(f"\\u{ord(c):04x}" for c in secret)
    for hidden in (base64.b64encode(secret.encode()).decode(), zipped, base64.b64encode(zipped.encode()).decode(), base64.b64encode(escaped.encode()).decode()):
        assert op6_secrets.scan(f"é {hidden} z")[1] == {(2, "assign", 2 + len(hidden), op6_secrets.scan(hidden)[1].copy().pop()[3])}
    assert {(a, b) for a, _, b, _ in op6_secrets.scan("q " + url)[1]} == {(2, 2 + 3 * (len(secret) - 1))}
    assert {(a, b) for a, _, b, _ in op6_secrets.scan("q " + escaped)[1]} == {(2, 2 + 6 * (len(secret) - 1))}
    assert op6_secrets.scan("%2525252525")[1] == set()
    plain = "Token: abcd token=abcdefgh AKIA" + "B" * 12 + " AKIAB " + "0f" * 16 + " " + "0f" * 15 + " ſecret=abcdefghij"
    assert op6_secrets.listed(op6_secrets.matches(plain)) == "assign:12:26,access:27:43,hex:50:82"
    assert op6_secrets.redacted(plain).startswith("Token: abcd [secret] [secret] AKIAB [secret] 0f")
    rows = op6_secrets.secrets(make(spark, [(1, plain), (2, None), (2, "")])).collect()
    assert {r.base_sha256 for r in rows if r.doc_id == 2} == {hashlib.sha256(b"").hexdigest()}
    assert op6_secrets.secrets(docs).count() == docs.count() and op6_secrets.secrets(docs.limit(0)).count() == 0


def test_secrets_in_base64_of_any_bytes():
    secret = b"password=hunter2hunter2"
    for raw in (b"\xef\xbb\xbf" + secret, "a\u00a0b\u3000c\u200b ".encode() + secret, "caf\u00e9 ".encode("latin-1") + secret, b"\x00\x1b\xff\xfe " + secret + b"\x00\x80"):
        for hidden in (base64.b64encode(raw).decode(), base64.b64encode(base64.b64encode(raw)).decode()):
            assert {x[:3] for x in op6_secrets.scan(f"q {hidden} z")[1]} == {(2, "assign", 2 + len(hidden))}
            assert op6_secrets.redacted(f"q {hidden} z") == "q [secret] z"
    assert op6_secrets.scan("q " + base64.b64encode(bytes(range(256))).decode())[1] == set()


def test_secrets_in_wrapped_base64():
    secret, rng = b"password=hunter2hunter2", random.Random(9)
    noise = bytes(rng.choice(b"abc \n") for _ in range(300))
    for end in ("\n", "\r\n", "\\n", "\n> "):
        for width in (76, 64, 30):
            for raw, whole in ((b"x" * (width * 3 // 4 - 9) + secret + noise, False), (gzip.compress(noise + secret + noise), True), (gzip.compress(noise) + gzip.compress(secret), True), (zlib.compress(noise + secret), True)):
                code = base64.b64encode(raw).decode()
                lines = [code[i:i + width] for i in range(0, len(code), width)]
                for before, after in (("q ", " z"), (f"Hello{end}", f"{end}and more"), (f"-----BEGIN KEY-----{end}", f"{end}-----END KEY-----")):
                    text = before + end.join(lines) + after
                    stop = len(before + end.join(lines if whole else lines[:2]))
                    assert {x[:3] for x in op6_secrets.scan(text)[1]} == {(len(before), "assign", stop)}
                    assert op6_secrets.redacted(text) == before + "[secret]" + text[stop:]
    short = base64.b64encode(b"token=12345678").decode().rstrip("=")
    assert len(short) == 19 and op6_secrets.redacted(f"q {short} z") == "q [secret] z"
    for pack in (gzip.compress, bz2.compress, lzma.compress, zlib.compress):
        hidden = base64.b64encode(pack(b"nothing here") + pack(secret)).decode()
        assert op6_secrets.redacted(f"q {hidden} z") == "q [secret] z"


def test_fingerprints(spark, texts):
    rows = list(enumerate([*texts, None]))
    got = {r.doc_id: r for r in op7_fingerprints.edited_and_next(make(spark, rows)).collect()}
    for i, t in rows:
        t, following = t or "", rows[i - 1][1] or ""
        edited = t[:len(t) - len(t) // 2] + following[:len(t) // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        own, changed, after = (op7_fingerprints.sketches([x])[0] for x in (t, edited, following))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (op7_fingerprints.shown(own), op7_fingerprints.shown(changed))
        assert (got[i].near_edited, got[i].near_next) == tuple(op7_fingerprints.likeness([(own, changed), (own, after)]))
    same = spark.createDataFrame([(1, "a b c")] * 5 + [(None, "z"), (None, None)], "doc_id bigint, text string").repartition(2)
    assert op7_fingerprints.edited_and_next(same).count() == 7 and op7_fingerprints.edited_and_next(same.limit(0)).count() == 0


def test_equal_substrings_share_interior_names():
    rng = random.Random(3)
    middle = prose(rng, 2000)
    a, b = op7_fingerprints.sketches([prose(rng, 30) + middle, prose(rng, 77) + middle])
    assert op7_fingerprints.likeness([(a, b), (a, a)])[0] > 0.85 and op7_fingerprints.likeness([(a, a)])[0] == 1


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(600, 8)), np.repeat(rng.normal(size=(1, 8)), 200, axis=0)])
    rows = [(i, [float(c) for c in v], "clash") for i, v in enumerate(x)] + [(900, None, ""), (1000, [0.0] * 8, ""), (1100, [float("nan")] * 8, ""), (1200, [1.0, None] * 4, ""), (None, [1.0] * 8, "")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, node string").repartition(3)
    got = op8_neighbours.nearest_neighbours(df, F.col("vec_id") % 100 == 0).collect()
    hits = total = 0
    for q in range(0, 800, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = sorted((s, i) for i, s in enumerate(d.tolist()) if i != q)[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(s - d[i]) < 1e-12 for _, i, s in mine)
        if q >= 600:
            assert [m[1] for m in mine] == [i for _, i in want]
        hits, total = hits + len({m[1] for m in mine} & {i for _, i in want}), total + 10
    assert hits >= 0.9 * total and {r.query_id for r in got} == set(range(0, 800, 100))
    few = op8_neighbours.nearest_neighbours(df.where("vec_id < 4"), F.col("vec_id") == 0)
    assert few.count() == 3 and op8_neighbours.nearest_neighbours(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_search_expands_its_whole_beam(spark):
    order = [r.node for r in spark.range(80).withColumnRenamed("id", "node").orderBy(F.xxhash64("node"), "node").collect()]
    doors, decoys, target = order[:40], order[40:79], order[79]  # a search enters by the first 40
    at = {n: 10.0 + i for i, n in enumerate(doors)} | {n: 5.0 + i / 100 for i, n in enumerate(decoys)} | {target: 1.0}
    nodes = op8_neighbours.written(op8_neighbours._packed(spark.createDataFrame([(n, [d, 0.0]) for n, d in at.items()], "node bigint, vector array<double>")), "nodes")
    ways = [*zip(doors, decoys), (doors[39], target)]  # only the furthest door leads to the target
    edges = spark.createDataFrame([(u, v, at[u] - at[v]) for u, v in ways], op8_neighbours.EDGE)
    asked = spark.createDataFrame([(-1, np.zeros(2).tobytes(), None)], "query bigint, asked binary, node bigint")
    found = op8_neighbours.graph_search(asked, nodes, edges, beam=40, entries=40).orderBy("d").first()
    assert (found.node, found.d) == (target, 1.0)


def test_first_search_finds_its_neighbours(spark, monkeypatch):
    """Recall of the graph and of one search without a measured answer to go on for, and the share of
    the table that it measures."""
    x = np.random.default_rng(5).normal(size=(4000, 16)) + 1000  # far from the origin
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node bigint, vector array<double>")
    nodes = op8_neighbours.written(op8_neighbours._packed(df), "nodes")
    edges = op8_neighbours.neighbour_graph(nodes, k=16, block=256)
    want = {q: set(np.argsort(((x - x[q]) ** 2).sum(axis=1))[1:11].tolist()) for q in range(0, 4000, 100)}
    held = {}
    for r in edges.where("u % 100 = 0").collect():
        held.setdefault(r.u, set()).add(r.v)
    assert all(len(h) == 16 for h in held.values()) and sum(len(held[q] & want[q]) for q in want) >= 0.9 * 400
    measured = []

    def counted(pairs, queries, nodes, real=op8_neighbours._measured):
        measured.append(pairs.count())
        return real(pairs, queries, nodes)
    monkeypatch.setattr(op8_neighbours, "_measured", counted)
    asked = nodes.where("node % 100 = 0").select(F.col("node").alias("query"), F.col("exact").alias("asked"), "node")
    found = op8_neighbours.graph_search(asked, nodes, edges, beam=24).where("node <> query")
    near = {}
    for r in found.orderBy("query", "d", "node").collect():
        near.setdefault(r["query"], []).append(r.node)
    assert sum(len(set(near[q][:10]) & want[q]) for q in want) >= 0.98 * 400
    assert sum(measured) <= 0.4 * 40 * 4000


def test_no_pair_of_the_graph_or_search_is_a_row(spark):
    """Of 3,000 nodes with 48 queries, parts get posts, not rows: no step of the graph or the search
    gives Spark as many rows as there are nodes, apart from the nodes and the two results."""
    x = np.random.default_rng(7).normal(size=(3000, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node bigint, vector array<double>")
    nodes = op8_neighbours.written(op8_neighbours._packed(df), "nodes")
    rows, pairs, real = {}, [], op8_neighbours.written
    with pytest.MonkeyPatch.context() as patch:
        def counted(table, name):
            out = real(table, name)
            rows.setdefault(name, []).append(out.count())
            if name == "found" and "kind" in out.columns:
                pairs.extend(len(r["b"]) // 8 for r in out.where(F.col("kind") == op8_neighbours.TURNS).select("b").collect())
            return out
        patch.setattr(op8_neighbours, "written", counted)
        edges = op8_neighbours.neighbour_graph(nodes, k=16, block=256)
        asked = nodes.where("node % 64 = 0").select(F.col("node").alias("query"), F.col("exact").alias("asked"), "node")
        found = op8_neighbours.graph_search(asked, nodes, edges, beam=24).where("node <> query")
    assert rows["graph"].pop() == 3000 * 16 and rows["found"].pop() >= 47 * 96
    assert len(rows["graph"]) > 2 and len(rows["found"]) > 2 and max(map(max, rows.values())) < 300
    assert 47 * 24 <= sum(pairs) <= 0.04 * 47 * 3000  # nodes expanded, each with some fifty steps
    near = {}
    for r in found.orderBy("query", "d", "node").collect():
        near.setdefault(r["query"], []).append(r.node)
    want = {q: np.argsort(((x - x[q]) ** 2).sum(axis=1))[1:11].tolist() for q in range(0, 3000, 64)}
    assert all(len(set(n)) == len(n) for n in near.values())
    assert sum(len(set(near[q][:10]) & set(want[q])) for q in want) >= 0.98 * 470


def test_search_widens_until_a_sample_is_found(spark):
    x = np.random.default_rng(6).normal(size=(1500, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in op8_neighbours.nearest_neighbours(df, F.col("vec_id") % 100 == 0, degree=3, beam=2).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = {q: set(np.argsort(((x - x[q]) ** 2).sum(axis=1))[1:11].tolist()) for q in range(0, 1500, 100)}
    assert sum(len(got[q] & want[q]) for q in want) >= 0.98 * 150


def test_language(spark, docs):
    rng = random.Random(6)
    rows = [(i, prose(rng, 30) if i % 2 else prose(rng, 30).translate(str.maketrans("abcde", "vwxyz")), "aa" if i % 2 else "zz") for i in range(200)]
    df = spark.createDataFrame([*rows, (500, "...", "aa"), (501, None, "aa"), (502, "abc", None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in op9_language.language_id(df, remainder(F.col("doc_id"), 4) == 2).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows) and got[500].lang_pred == got[501].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 203
    untaught = op9_language.language_id(docs.withColumn("lang", F.lit(None).cast("string")), never())
    assert {r.lang_pred for r in untaught.collect()} == {"und"}
    folded = op9_language.train(df.select("lang", "text"), most_cells=1024)
    assert len(folded[1]) == 512 + 2
    assert op9_language.language_id(df.limit(0), never()).count() == 0


def test_pipeline_stages(spark):
    frames = [spark.read.parquet(f"{TINY}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.written(stage(spark, frames[-1], TINY), "stage"))
    whole, language, quality, single, masked, packed = frames
    assert all(f.columns == whole.columns for f in frames[1:5])
    bad = {r.doc_id for r in spark.read.parquet(f"{TINY}/labels.parquet").where("quality = 0").collect()}
    kept = {r.doc_id for r in quality.collect()}
    assert len(kept & bad) <= 0.1 * len(bad) and language.count() >= 0.99 * whole.count()
    groups = {r.class_id for r in op3_chosen_path.join(quality).collect()}
    assert {r.doc_id for r in single.collect()} == groups
    assert all(r.text == op6_secrets.redacted(s.text) for r, s in zip(masked.orderBy("doc_id").collect(), single.orderBy("doc_id").collect()))
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in masked.collect()}


def clashing(df):
    """`df` with columns named like those that the stages make."""
    for k, name in enumerate(("score", "predicted", "lang_pred", "place", "text_hash", "id_key", "row", "first", "text_kept", "odd name, <here>")):
        df = df.withColumn(name, F.lit(f"own {k}"))
    return df


def test_every_stage_takes_nulls_repeats_empty_tables_and_clashing_names(spark):
    whole = spark.read.parquet(f"{TINY}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0)] * 2, whole.schema)
    more = clashing(whole.limit(40).unionByName(odd))
    kept = {name: stage(spark, more, TINY) for name, stage in corpus_pipeline.STAGES}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, clashing(odd).limit(0), TINY).count() == 0, name
        if name != "packing":
            assert kept[name].columns == more.columns
            rows = kept[name].collect()
            assert rows and all(r["row"] == "own 6" and r["score"] == "own 0" and r["text_hash"] == "own 4" and r["odd name, <here>"] == "own 9" for r in rows), name
    assert kept["language_id"].where("coalesce(text, '') = ''").count() == 0
    assert kept["near_duplicates"].where("coalesce(text, '') = ''").count() == 1
    assert kept["secrets"].count() == kept["packing"].where("piece = 0").count() == 44


@pytest.fixture(scope="module")
def raw_corpus(spark, tmp_path_factory):
    """A folder of documents and labels with copies, near copies, secrets, null and empty rows."""
    rng = random.Random(11)
    good = spark.read.parquet(f"{TINY}/documents.parquet").join(spark.read.parquet(f"{TINY}/labels.parquet").where("quality = 1"), "doc_id")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in good.select("doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").collect() if len(r.text) > 300][:60]
    low = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{TINY}/documents.parquet").join(
        spark.read.parquet(f"{TINY}/labels.parquet").where("quality = 0"), "doc_id").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    copies = [(10_000 + k, rows[k][1], rows[k][2], "copy", rows[k][4]) for k in range(8)]
    near = [(20_000 + k, rows[k][1] + " one more", rows[k][2], "near", rows[k][4] + 9) for k in range(4, 12)]
    hidden = base64.b64encode(b"and so password = hunter22hunter22 it is").decode()
    leaks = [(30_000 + k, f"{rows[20 + k][1]} token={'Q' * (8 + k)} {hidden} {rng.random()}", rows[20 + k][2], "leak", 1) for k in range(6)]
    given = [*rows, *low, *copies, *near, *leaks, (None, None, None, None, None), (40_000, "", "en", "s", 0), (40_001, "... 12", "en", "s", 6), rows[0]]
    folder = str(tmp_path_factory.mktemp("corpus"))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(given, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{TINY}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder, given


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_pipeline_run_against_plain_stages(spark, raw_corpus):
    """run() against the two classifiers' decisions and plain Python for all that follows them."""
    from tokenizers import Tokenizer
    from sublens.llm.queries import vocabulary_file
    folder, given = raw_corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    packed = corpus_pipeline.run(spark, folder).collect()
    spoken = {r.doc_id for r in op9_language.language_id(docs, remainder(F.col("doc_id"), 4) == 2).collect() if r.lang_pred != "und" and r.score >= 0.5}
    fine = {r.doc_id for r in op5_quality.quality(docs, spark.read.parquet(f"{folder}/labels.parquet"), remainder(F.col("doc_id"), 3) == 1).collect() if r.predicted}
    left = sorted({g for g in given if g[0] in spoken and g[0] in fine}, key=lambda g: g[0])
    assert {None, 40_000, 40_001}.isdisjoint(g[0] for g in left) and len(left) >= 70
    sets, group = [shingles(g[1]) for g in left], list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if x in (a, b) else x for x in group]
    first = [g for i, g in enumerate(left) if group[i] == i]
    assert len(left) - len(first) >= 8 and all(g[3] != "copy" for g in first)
    lib = Tokenizer.from_str(vocabulary_file("word_bpe_49k.json").decode())
    want = {}
    for g in first:
        text = g[1]
        if g[3] == "leak":  # the masked forms are known: the assignment and the whole base64 run
            head, secret, code, tail = re.fullmatch(r"(.*) (token=Q+) (\S+) (\S+)", text, re.S).groups()
            text = f"{head} [secret] [secret] {tail}"
        ids = [*lib.encode(text, add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 4096):
            want[g[0], at // 4096] = (at, len(ids[at:at + 4096]), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at:at + 4096])))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packed} == want
    filled = {}
    for r in packed:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in filled.values():
        assert all(a[0] + a[1] == b[0] for a, b in zip(sorted(spans), sorted(spans)[1:])) and min(spans)[0] == 0 and sum(n for _, n in spans) <= 4096
