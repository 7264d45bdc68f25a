"""Alignment of tokenizers, whitening and web archives against brute force."""

import gzip
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("tiktoken")
sentencepiece = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")

from parityflow.llm import bpe, crosstoken, warc, whitening  # noqa: E402

A_PATH, B_PATH = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
ODD = [chr(i) for i in (0, 9, 10, 13, 133, 160, 0x2581, 0x558, 0x1C89, 0x2028, 0x3000, 0x1F600, 0x4E2D, 0x33000)]
ODD += list("aZé9ßñЖ.,!") + ["'s", " x", "  ", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "thing", " the", "mere"]


def odd_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ODD + [" "] * 6) for _ in range(r.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def contents():
    return bpe.read_vocabulary(A_PATH), crosstoken.read_pieces(B_PATH)


@pytest.fixture(scope="module")
def slow():
    """Tokens of a text, with their bytes, by the two libraries themselves."""
    a = tokenizers.Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    byte_of = {c: i for i, c in enumerate(bpe.byte_letters())}

    def tokens(text):
        if not text:
            return [], []
        mine = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        other = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (mine, other) if b"".join(x for _, x in mine) == whole == b"".join(x for _, x in other) else ([], [])

    return tokens


def slow_groups(mine, other):
    ends = [set(np.cumsum([len(x) for _, x in t]).tolist()) for t in (mine, other)]
    groups = []
    for side, tokens in enumerate((mine, other)):
        at, group = 0, 0
        for i, raw in tokens:
            while len(groups) <= group:
                groups.append(([], []))
            groups[group][side].append(i)
            at += len(raw)
            group += at in ends[0] & ends[1]
    return groups


def slow_counts(texts, slow):
    aligned = [slow_groups(*slow(t)) for t in texts]
    links = [Counter((a, b) for x, y in g for a in x for b in y) for g in aligned]
    held = Counter(pair for c in links for pair in c)
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for g, c in zip(aligned, links):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        best = sum(k for (a, b), k in c.items() if held[a, b] == most[a])
        digest = hashlib.sha256(said.encode()).hexdigest() if g else ""
        out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), best, sum(held[p] * k for p, k in c.items()), digest))
    return out


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_linked_counts_are_those_of_brute_force(spark, contents, slow):
    texts = [*odd_texts(250, 2), None, "", " ", "same text here", "same text here", "a" * 3_000, " " * 1_500 + "x", "ab" * 900, "\n" * 40, "naïve café " * 30]
    docs = spark.createDataFrame([(i if i % 9 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_a int").repartition(5)
    got = crosstoken.linked_counts(docs, *contents)
    assert sorted(tuple(r[c] for c in NAMES) for r in got.collect()) == sorted(slow_counts(texts, slow))
    assert crosstoken.linked_counts(docs.limit(0), *contents).count() == 0


def test_blocks_add_up_to_the_corpus(spark, contents, slow):
    words = "the tokens of a longer text are linked here, whatever block holds them; naïve words too".split()
    r = random.Random(4)
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = {i: w for i, w in enumerate(slow_counts(texts, slow))}
    for parts in (1, 40):
        got = crosstoken.linked_counts(docs.repartition(parts), *contents).collect()
        assert {r.doc_id: tuple(r[c] for c in NAMES) for r in got} == want


def test_aligned_groups_spell_the_text(spark, contents, slow):
    texts = [*odd_texts(60, 7), None, ""]
    docs = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, a_ids int")
    out = crosstoken.align_tokens(docs.withColumnRenamed("a_ids", "keep"), *contents)
    assert out.columns == ["text", "keep", "a_ids", "b_ids", "a_to", "b_to"]
    assert crosstoken.align_tokens(docs, *contents).columns == ["text", "a_ids", "b_ids", "a_to", "b_to"]
    for r in out.collect():
        ends = zip([0, *r.a_to], r.a_to, [0, *r.b_to], r.b_to)
        assert [(r.a_ids[a:b], r.b_ids[c:d]) for a, b, c, d in ends] == slow_groups(*slow(r.text))


def test_shared_ends_of_random_lists():
    r = np.random.default_rng(1)
    for _ in range(300):
        a, b, a_from, at = [], [], [0], 0
        for _ in range(r.integers(1, 5)):
            n = int(r.integers(1, 60))
            a += sorted({*(at + r.integers(1, n + 1, r.integers(0, 20))).tolist(), at + n})
            b += sorted({*(at + r.integers(1, n + 1, r.integers(0, 20))).tolist(), at + n})
            at += n
            a_from.append(len(a))
        got = crosstoken.shared_ends(np.array(a), np.array(b), np.array(a_from))
        assert np.array(a)[got].tolist() == sorted(set(a) & set(b))


def test_both_fast_and_slow_tokens_are_the_librarys(contents):
    library = tokenizers.Tokenizer.from_file(A_PATH)
    library.encode_special_tokens = True
    tokens = crosstoken.ByteTokens(contents[0])
    every = [" " + chr(i) * k for i in range(1, 0x558) for k in (1, 2)] + [" " + t for t in odd_texts(500, 11)]
    assert tokens.fast is not None
    assert tokens.encode(every) == [library.encode(t, add_special_tokens=False).ids for t in every]


def slow_whitening(vectors):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted({tuple(v) for v in x.tolist()}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((fit * n - sums) / n).astype(float)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    return n, [int(sum((n * c - s) ** 2 for c, s in zip(v, sums))) for v in x.tolist()], ((x * n - sums) / n).astype(float), e[::-1], u[:, ::-1]


def test_whitening_is_that_of_brute_force(spark):
    r = np.random.default_rng(5)
    basis = r.normal(size=(20, 20))
    made = [[float(np.float32(c)) for c in (r.normal(size=20) @ basis)] for _ in range(400)]
    vectors = [*made, *[made[0]] * 50]
    odd = [(900, None), (901, [1.0] * 19 + [None]), (902, [float("nan")] * 20), (903, [float("inf")] * 20), (904, [1.0, 2.0]), (905, [])]
    rows = [(i if i else None, v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, component string").repartition(6)
    got = defaultdict(dict)
    out = whitening.whiten(df)
    for row in out.collect():
        got[row.vec_id, row.deviation].setdefault(row.component, []).append(row)
    n, deviation, centred, e, u = slow_whitening([v for _, v in rows])
    assert n == 400 and sum(len(x) for g in got.values() for x in g.values()) == len(rows) * 16
    signs = {}
    for (i, _), dev, c in zip(rows, deviation, centred):
        for k in range(16):
            row = got[i, dev][k + 1][0]
            want = float(c @ u[:, k]) / np.sqrt(e[k])
            if abs(want) > 1e-3:
                assert signs.setdefault(k, np.sign(want * row.whitened)) == np.sign(want * row.whitened)
            assert abs(abs(row.whitened) - abs(want)) < 1e-8
            assert abs(row.explained - e[k] / e.sum()) < 1e-9 and row.n == n and row.identity_error < 1e-9


def test_whitening_without_variance_or_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1e300, 0.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(df).collect() == []
    assert whitening.whiten(df.limit(0)).schema.simpleString() == "struct<vec_id:bigint,component:int,n:bigint,deviation:bigint,whitened:double,explained:double,identity_error:double>"
    flat = spark.createDataFrame([(i, [float(i), 7.0, float(i)]) for i in range(5)], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.component) for r in whitening.whiten(flat).collect()) == [(i, 1) for i in range(5)]


def test_deviation_of_large_vectors_is_exact_or_null(spark):
    rows = [(1, [2.0**40, 1.0]), (2, [-(2.0**40), 3.0]), (3, [0.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    dev = dict(zip((1, 2, 3), slow_whitening([v for _, v in rows])[1]))
    got = {r.vec_id: r.deviation for r in whitening.whiten(df).filter("component = 1").collect()}
    assert got == {k: v if v < 2**63 else None for k, v in dev.items()}


def test_scatter_is_split_over_the_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    monkeypatch.setattr(whitening, "SEGMENT_ROWS", 100)
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(r.normal(size=(250, 4)).round(3).tolist())], "vec_id long, embedding array<double>")
    got = {(row.vec_id, row.component): row.whitened for row in whitening.whiten(df).collect()}
    _, _, centred, e, u = slow_whitening([row.embedding for row in df.orderBy("vec_id").collect()])
    want = centred @ u / np.sqrt(e)
    assert all(abs(abs(got[i, k + 1]) - abs(want[i, k])) < 1e-8 for i in range(250) for k in range(4))


PAGES = [
    (5, "http://a/5", "x" * 200), (3, "http://a/3", "x" * 200), (9, None, "x" * 200), (1, "http://b/1", "short"), (2, "http://b/2", "short"),
    (4, "http://c/ é\r\nX: y", "é" * 50), (6, "http://c/6", "é" * 50), (7, "u", None), (8, "u", ""), (None, "n", "x" * 200), (None, "n", "q\r\n\r\nWARC/1.1\r\n"),
    (10, "big", "line\n" * 200_000), (11, "big", "line\n" * 200_000), (3, "again", "x" * 200),
]


def pages(spark):
    return spark.createDataFrame([(i, u, h, "z") for i, u, h in PAGES], "page_id long, url string, html string, payload string").repartition(3)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives_hold_the_pages(spark, tmp_path, compression):
    path = f"{tmp_path}/archive"
    warc.write_warc(warc.page_records(pages(spark)), path, compression)
    back = warc.read_warc(spark, path).collect()
    first = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, u, h in PAGES:
        again = i is not None and first.get(h, i) < i
        body = (h or "").encode()
        uri = u and u.replace("\r\n", " ")
        want.append((f"urn:page:{'' if i is None else i}", "revisit" if again else "response", uri, f"urn:page:{first[h]}" if again else None, len(body), hashlib.sha256(body).hexdigest(), None if again else body))
    got = [(r.record_id, r.record_type, r.target_uri, r.refers_to, r.payload_length, r.payload_digest.split(":")[1], None if r.payload is None else bytes(r.payload)) for r in back]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    if compression == "gzip":  # the files are ordinary gzip files of records
        whole = b"".join(gzip.open(f).read() for f, _ in warc.listed(path))
        assert whole.startswith(b"WARC/1.1\r\n") and whole.count(b"WARC-Record-ID: ") == len(PAGES)


def test_predicates_reach_the_scan_and_payloads_are_skipped(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/archive"
    warc.write_warc(warc.page_records(pages(spark)), path)
    read = warc.read_warc(spark, path)
    some = read.filter((F.col("record_type") == "revisit") & F.col("target_uri").startswith("http://a"))
    assert [(r.record_id, r.payload) for r in some.collect()] == [("urn:page:5", None)]
    assert "Filter" not in some._jdf.queryExecution().optimizedPlan().toString()  # the scan tests them all
    assert read.filter("payload_length > 1000").count() == 2  # the long page, and what stands for its copy
    assert all(r.payload is None for r in warc.read_warc(spark, path, payload=False).collect())
    # a record that fails its predicate is stepped over without its block
    reader = warc.WarcReader({"path": path})
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("file",), "x")])) == [warc.EqualTo(("file",), "x")]
    monkeypatch.setattr(warc.Zipped, "block", lambda self, n: pytest.fail("a payload was decoded"))
    rows = [r for p in reader.partitions() for f in p.files for r in reader.records(*f)]
    assert len(rows) == sum(1 for r in read.filter("record_type = 'revisit'").collect())


def test_foreign_files_and_partitions(spark, tmp_path):
    def foreign(kind, body, extra=""):
        return f"WARC/1.0\r\nwarc-type: {kind}\r\n{extra}Content-Type: text/plain\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    made = [foreign("warcinfo", b"software: x"), foreign("resource", b"WARC/1.0\r\n\r\n" * 10_000, "WARC-Target-URI: <http://x/\r\n  y>\r\n"), foreign("metadata", b"")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, made)))
    (tmp_path / "b.warc").write_bytes(b"".join(made))
    (tmp_path / "_c.warc").write_bytes(b"junk")
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted((r.record_type, len(r.payload)) for r in got) == sorted([("warcinfo", 11), ("resource", 120_000), ("metadata", 0)] * 2)
    assert {r.target_uri for r in got} == {None, "http://x/ y"}
    assert warc.read_warc(spark, str(tmp_path)).filter("record_type = 'metadata'").count() == 2
    assert [len(p.files) for p in warc.WarcReader({"path": str(tmp_path), "partitionBytes": "1"}).partitions()] == [1, 1]
    assert [len(p.files) for p in warc.WarcReader({"path": str(tmp_path)}).partitions()] == [2]
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(made[1])[:-20])
    with pytest.raises(Exception, match="cut off|no end"):
        warc.read_warc(spark, str(tmp_path)).collect()


def test_empty_tables_make_empty_archives(spark, tmp_path):
    assert warc.archive_pages(pages(spark).limit(0), f"{tmp_path}/none").collect() == []


def test_texts_that_share_an_id_stay(spark):
    import corpus_pipeline

    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text), (2, text + " more"), (3, "a quite different text of some words"), (3, "and another one that shares its id"), (3, None), (3, ""), (3, "and another one that shares its id"), (None, text), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    want = [rows[0], *rows[2:6], *rows[7:]]
    assert sorted(kept, key=repr) == sorted(want, key=repr)
