"""Links and searches against brute force."""

import math
import random
import tracemalloc
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from parityflow.llm import graph, jaccard, neardup, passages, shingles, topk
from pyspark.sql import functions as F


def roots(pairs, nodes):
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near(a, b):
    both = len(a & b)
    return bool(a and b) and 100 * both >= 75 * len(a | b)


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(4_000)]
    rows, passage = [], [r.choice(words) for _ in range(70)]
    for i in range(150):
        n = r.choice([1, 3, 4, 5, 6, 9, 30, 80, 200, 400])
        base = [r.choice(words) for _ in range(n)]
        if r.random() < 0.3:
            base[n // 2 : n // 2] = passage
        for _ in range(r.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(int(len(copy) * r.choice([0, 0.01, 0.03, 0.05]))):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((len(rows) * 3 + 1, r.choice([" ", "\n", " \t "]).join(copy)))
    return rows + [(2, None), (5, ""), (8, " \n"), (11, rows[0][1]), (None, rows[0][1]), (11, rows[9][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_against_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).repartition(3)
    sets = [(i, shingle_set(t)) for i, t in rows]
    pairs = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if a is not None and b is not None and near(s, t)]
    want = roots(pairs, {i for i, _ in rows if i is not None}) | {None: None}
    got = jaccard.jaccard_components(docs).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=repr) == sorted(((i, len(s), want[i]) for i, s in sets), key=repr)
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_open_groups_give_off_no_pairs():
    """Rows of the comparing steps are bounded by ids and components, not by pairs of a group."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(64)]
    texts = [" ".join(base[:-k] + [f"x{i}y{j}" for j in range(k)]) for i in range(60) for k in [r.choice([3, 5])]]
    sets = list(shingles.shingle_sets(texts))
    near_sets = [(a, b) for a in range(60) for b in range(a) if jaccard.similar(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))]
    assert len(near_sets) > 600
    one = np.ones(60, np.int64)
    table = {"id": np.arange(60), "n": [len(s) for s in sets], "component": np.arange(60), "body": [jaccard._sketch(s) for s in sets], "cell": one, "mine": one, "bin": one}
    ids = jaccard._compare(pa.table(table))
    assert ids.num_rows == len(set(ids["id"].to_pylist())) == 60
    links = jaccard._join(pa.table(table | {"body": [t.encode() for t in texts]}))
    got = list(zip(links["a"].to_pylist(), links["b"].to_pylist()))
    want = roots(near_sets, range(60))
    assert roots(got, range(60)) == want and len(got) == 60 - len(set(want.values()))
    assert jaccard._join(pa.table(table | {"body": [b"", b" "] * 30})).num_rows == 0


def peak_mb(rows):
    """MB that Python and numpy hold at most while ``rows`` are gone through."""
    tracemalloc.start()
    for _ in rows:
        pass
    held = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return held


def test_signing_holds_little_more_than_the_signatures(monkeypatch):
    """A task's signatures (8 MB here) are grouped where they lie."""
    rng = np.random.default_rng(8)
    sets = list(rng.integers(1, 1 << 63, (1_000, 1_000), dtype=np.uint64))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(1_000)), pa.nulls(1_000, pa.string())], ["id", "text"])
    monkeypatch.setattr(jaccard, "_sets", lambda batch: [(batch, sets)])
    monkeypatch.setattr(jaccard, "signatures", lambda tokens, frequent: tokens.copy())
    assert peak_mb(jaccard._sign(np.empty(0, np.uint64))([batch])) < 50


def test_comparing_holds_few_texts_of_a_batch():
    texts = [b"%d " % i + b"word " * 20_000 for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.nulls(200, pa.int64()), pa.nulls(200, pa.int64()), pa.array(texts), pa.array(texts)], list("abxy"))
    del texts
    assert peak_mb(jaccard._verify([batch])) < 20


def test_signed_rows_hold_every_signature_and_id_once():
    r = np.random.default_rng(9)
    held = [(np.unique(r.integers(0, 40, 12)).astype(np.uint64) << np.uint64(40) | np.uint64(i), int(x)) for i, x in enumerate(r.integers(-5, 5, 60))]
    want = {(int(s) >> 16, x) for sigs, x in held for s in sigs}
    got, firsts = [], []
    for b in jaccard._packed(held):
        for sig, own, more in zip(*(c.to_pylist() for c in b.columns)):
            ids = [own, *np.frombuffer(more or b"", np.int64).tolist()]
            assert ids == sorted(ids) and more != b""
            firsts.append(sig)
            got += [(sig, x) for x in ids]
    assert not held and sorted(got) == sorted(want) and len(firsts) == len(set(firsts))


def test_jaccard_components_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_ROWS", 16)
    monkeypatch.setattr(jaccard, "BIN_ROWS", 60)
    monkeypatch.setattr(jaccard, "CHUNK_SHINGLES", 2_000)
    joined, held = jaccard._joined, []
    monkeypatch.setattr(jaccard, "_joined", lambda likely, docs, groups: held.append(likely.count()) or joined(likely, docs, groups))
    r, rows = random.Random(9), []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(90)]
        for _ in range(70):  # copies of one base, many just above or just below the threshold
            copy = list(base)
            for _ in range(r.choice([1, 2, 3])):
                copy[r.randrange(90)] = f"x{r.random()}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(3, ""), (150, rows[80][1] + " a b"), (150, rows[149][1] + " c")]
    sets = [(i, shingle_set(t)) for i, t in rows]
    want = roots([(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if near(s, t)], {i for i, _ in rows})
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted((i, len(s), want[i]) for i, s in sets)
    assert held and held[0] > 0


def test_components_start_from_written_links(spark, monkeypatch):
    """No task runs the Python that makes links and the Python that joins them, which would take two workers."""
    plans, join = [], jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda links: plans.append(links._jdf.queryExecution().optimizedPlan().toString()) or join(links))
    r, base, rows = random.Random(9), [f"w{i}" for i in range(90)], []
    for i in range(70):
        copy = list(base)
        for _ in range(r.choice([1, 2, 3])):
            copy[r.randrange(90)] = f"x{r.random()}"
        rows.append((i, " ".join(copy)))
    jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(plans) == 3 and not [p for p in plans if "InArrow" in p]


def test_signatures_of_similar_sets_meet():
    r = np.random.default_rng(3)
    for n in [1, 2, 5, 31, 63, 64, 65, 90, 127, 128, 300, 1_000]:
        for often in (0.0, 0.4, 0.9, 1.0):
            for _ in range(12):
                x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
                drop = int(r.integers(0, n // 7 + 1))
                y = np.unique(np.concatenate([x[drop:], r.integers(0, 1 << 63, int(r.integers(0, n // 7 + 1)), dtype=np.uint64)]))
                frequent = np.unique(np.concatenate([x, y])[r.random(len(x) + len(y)) < often])
                if jaccard.similar(len(np.intersect1d(x, y)), len(x), len(y)):
                    assert np.intersect1d(jaccard.signatures(x, frequent), jaccard.signatures(y, frequent)).size, (n, often)


def test_sketches_bound_the_difference():
    r = np.random.default_rng(5)
    for n, m in ((400, 520), (520, 500), (3_000, 2_300)):
        x, y = (np.unique(r.integers(0, 1 << 63, k, dtype=np.uint64)) for k in (n, m))
        y = np.unique(np.concatenate([y[: m // 2], x[: n // 2]]))
        a, b = (np.frombuffer(jaccard._sketch(v), np.uint64) for v in (x, y))
        assert jaccard._differ(a, b) <= len(np.setxor1d(x, y))


def test_shingle_sets_of_odd_texts():
    texts = ["", None, "one", "A b\tc\nd", "a b c d e", "A B C D E f", " x " * 7, "é Ä ß d e f", "w " * 300_000]
    sizes = [len(s) for s in shingles.shingle_sets(texts)]
    assert sizes == [len(shingle_set(t)) for t in texts]
    same = list(shingles.shingle_sets(["A b c d E f", "a B c d e F"]))
    assert np.array_equal(*same)


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 199)]
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()}
    want = roots(pairs, {n for p in pairs for n in p})
    want.pop(7, None), got.pop(7, None)
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_top_k_against_all_scores(spark):
    r = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(400, 6)).round(1))] + [
        (900, None), (901, [float("nan")] * 6), (902, [None] * 6), (903, [1.0, 2.0]), (904, [0.5] * 6), (904, [0.5] * 6), (905, [0.0] * 6), (906, []), (None, [1.0] * 6), (907, [1e30] * 6),
        (908, [3e5, -2.0, 0.0, 1.0, 1.0, 1.0]), (909, [-3e5, 7.5, 0.0, 1.0, 1.0, 1.0]), (910, [2e5] * 6), (911, [-1e38, 1.0, 0.0, 0.0, 0.0, 0.5]), (908, [1e7] * 6)
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    asked = df.filter("vec_id % 50 = 0 OR vec_id >= 900")
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(df, asked, k=7).collect())
    sound = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    ints = [(i, tuple(math.floor(Fraction(x) * 1024) for x in v)) for i, v in sound]
    want, seen = [], set()
    for i, q in ints:
        if (i % 50 and i < 900) or (i, q) in seen:
            continue
        seen.add((i, q))
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ints if j != i and len(v) == len(q))[:7]
        want += [(i, n + 1, j, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for n, (s, j) in enumerate(scores)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), asked).count() == 0


def test_threshold_algorithm_stops_early():
    rows = np.arange(30_000, dtype=np.int64).reshape(-1, 3) * np.array([1, 1, -1])
    order = np.argsort(rows, axis=0, kind="stable")
    ids, scores = topk.best_of_block(rows, np.arange(10_000), order, np.array([1, 2, -3]), 9_999, 3)
    assert ids.tolist() == [9_998, 9_997, 9_996]


@pytest.mark.parametrize("chunk", [64, 2_048])
def test_embedding_links_against_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(neardup, "CHUNK_ROWS", chunk)
    r = np.random.default_rng(2)
    rows = []
    for i in range(60):
        base = r.normal(size=16)
        for _ in range(r.choice([1, 2, 9])):
            rows.append((len(rows), (base + r.normal(size=16) * r.choice([0, 0.05, 0.2])).astype(np.float32).tolist(), int(i % 3)))
    rows += [(5_000, rows[0][1], 0), (5_001, rows[0][1], 1), (5_002, rows[0][1], None), (5_003, None, 0), (5_004, [0.0] * 16, 0), (5_005, [float("inf")] * 16, 0), (5_006, [1.0], 0), (5_007, [1.0], 0), (5_008, [None], 0), (5_009, [], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit("x"))
    sound = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    pairs = [(a, b) for x, (a, u, s) in enumerate(sound) for b, v, t in sound[:x] if s == t and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98]
    comp, n = roots(pairs, [i for i, _, _ in rows]), {i: 0 for i, _, _ in rows}
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    got = {x.vec_id: x for x in neardup.link_embeddings(df).collect()}
    assert len(got) == len(rows)
    hit = sum(got[i].n_links for i in n)
    assert all(got[i].n_links <= n[i] for i in n) and hit >= 0.97 * sum(n.values())
    assert sum(got[i].component_id == comp[i] for i in n) >= len(rows) - 2
    assert all(x.kept == (x.vec_id == x.component_id) for x in got.values() if x.vec_id is not None)
    assert neardup.link_embeddings(df.limit(0)).count() == 0


def test_a_dense_bucket_is_compared_in_bounded_memory():
    rng, n = np.random.default_rng(4), 1_500
    vectors = (rng.normal(size=64) + rng.normal(size=(n, 64)) * 0.01).astype(np.float32)
    ids = pa.array(range(n), pa.int64())
    embedding = pa.ListArray.from_arrays(pa.array(range(0, 64 * n + 1, 64), pa.int32()), pa.array(vectors.reshape(-1)))
    same = {"cell": pa.repeat(pa.scalar(7, pa.int64()), n), "n": pa.array([2] * n, pa.int64()), "t": pa.array([0] * n, pa.int32()), "mine": pa.array([1] * n, pa.int32())}
    table = pa.table({"k1": ids, "k2": ids, "rep": ids, "embedding": embedding, "code": pa.array([bytes(8)] * n, pa.binary()), **same})
    tracemalloc.start()
    got = neardup._compare(table, 0.98).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200_000_000  # 1.1 million pairs of 64 numbers are 1.2 GB when held at once
    assert {(x["a"], x["n"]) for x in got if x["counts"]} == {(i, 2 * (n - 1)) for i in range(n)}
    assert {(x["a"], x["b"]) for x in got if not x["counts"]} == {(i, 0) for i in range(1, n)}


def test_repeated_passages_are_found_and_clean_texts_left(spark):
    r = random.Random(6)
    sentence = lambda: " ".join(f"v{r.randrange(9_000)}" for _ in range(r.randint(6, 16))) + "."
    passage = " ".join(sentence() for _ in range(6))
    rows = []
    for i in range(40):
        text = " ".join(sentence() for _ in range(12))
        rows.append((i, f"{text[: text.index('.') + 1]} é {passage} {text[text.index('.') + 2 :]}" if i % 4 == 0 else text))
    rows += [(100, None), (101, ""), (102, rows[0][1]), (102, rows[0][1]), (None, rows[0][1]), (103, "a. " * 200)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {x.doc_id for x in got} == {i for i in range(1, 40) if i % 4 == 0} | {102}
    text = dict(r_ for r_ in rows if r_[0] is not None)
    for x in got:
        assert x.kept_doc_id == 0 and x.n_words >= 30
        part = text[x.doc_id][x.start : x.finish]
        assert (part in passage or passage[:200] in part or part[-100:] in passage) and len(part.split()) == x.n_words
    assert passages.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passages_of_long_texts_and_of_rows_that_share_an_id(spark):
    r = random.Random(12)
    sentence = lambda: " ".join(f"q{r.randrange(90_000)}" for _ in range(14)) + "."
    text = " ".join(sentence() for _ in range(7_000))  # about three blocks
    clean, part = " ".join(sentence() for _ in range(2_500)), text[:600]
    rows = [(1, text), (2, f"{clean} {text}"), (3, f"{part} {sentence()}"), (3, f"{sentence()} {sentence()} {part}")]
    rows = [(i, t[: t.rindex(".") + 1]) for i, t in rows]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    (whole,) = [x for x in got if x.doc_id == 2]
    assert (whole.start, whole.finish, whole.n_words) == (len(clean) + 1, len(rows[1][1]), len(text.split()))
    here = [x for x in got if x.doc_id == 3]
    texts = [t for i, t in rows if i == 3]
    assert len(here) == 2 and all(any(t[x.start : x.finish] in text and x.finish - x.start > 400 for t in texts) for x in here)


def test_copies_of_over_50_words_are_found_however_they_are_cut(spark):
    r = random.Random(21)
    words = lambda n: " ".join(f"p{r.randrange(90_000)}" for _ in range(n))
    line = lambda n: words(n) + ".\n"
    short_lines = "".join(line(5) for _ in range(11))
    bridged = line(20) + line(3) + line(20) + line(4) + line(20)
    run_on = f"{words(24)}. {words(9)}. {words(22)}"
    one_sentence = words(52)
    rows, spans = [], {}
    for n, part in enumerate((short_lines, bridged, run_on, one_sentence)):
        rows.append((n, f"{words(30)} {part.strip()} {words(25)}."))
        head = f"{words(33)}. {words(21)} "
        spans[10 + n] = (len(head), len(head) + len(part.strip()))
        rows.append((10 + n, f"{head}{part.strip()} {words(30)}."))
    # short lines of which every tenth word or so is another
    changed = [words(5) for _ in range(30)]
    rows += [(5, "\n".join(changed)), (15, "\n".join(c if i % 8 else words(5) for i, c in enumerate(changed)))]
    # a bridge is no match: short lines between clean paragraphs and clean lines between marked ones stay
    lines = [line(20), line(20)]
    rows += [(6, lines[0] + lines[1]), (16, lines[0] + "".join(line(5) for _ in range(9)) + lines[1])]
    got = {}
    for x in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(x.doc_id, []).append(x)
    assert set(got) == {10, 11, 12, 13, 15}
    text = dict(rows)
    for i, (start, finish) in spans.items():
        (x,) = got[i]
        # at most seven words are missing at either end
        assert start <= x.start and x.finish <= finish and x.kept_doc_id == i - 10
        assert len(text[i][start : x.start].split()) < passages.GAP and len(text[i][x.finish : finish].split()) < passages.GAP
        assert len(text[i][x.start : x.finish].split()) == x.n_words


def test_paragraph_families_against_all_pairs(spark):
    r = random.Random(31)
    word = lambda: f"u{r.randrange(90_000)}"
    rows = []
    for _ in range(40):
        base = [word() for _ in range(60)]
        for _ in range(15):  # pairs of variants, which are mostly less similar to other pairs of the family
            one = list(base)
            one[r.randrange(4, 56)] = word()
            other = list(one)
            other[r.randrange(4, 56)] = word()
            rows += [" ".join(one), " ".join(other)]
    sets = [shingle_set(t) for t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a - a % 30, a) if near(sets[a], sets[b])]
    node = [int(passages.Paragraphs(t.encode(), np.array([0])).node[0]) for t in rows]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(rows)], "id long, text string, key long")
    got = {x.node: x.component for x in passages.paragraph_clusters(docs).collect()}
    missed = sum(got.get(node[a], node[a]) != got.get(node[b], node[b]) for a, b in pairs)
    assert missed <= 0.02 * len(pairs), (missed, len(pairs))
    comp = roots(pairs, range(len(rows)))
    assert all(len({comp[i] for i in range(len(rows)) if got.get(node[i]) == c}) == 1 for c in set(got.values()))
