"""Line dedup, mixing, language, personal data, pipeline: brute force and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from parityflow.llm import language, linededup, mixing, pii
from pyspark.sql import functions as F

ODD = [(1, None, "s", None), (2, "", None, "en"), (2, "", None, "en"), (None, "some text here ok", "s", "en"), (3, "word " * 30_000, "t", "de")]
SCHEMA = "doc_id long, text string, source string, lang string"


def brute_lines(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(lower)
    first = {}
    last = 1 << 63
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(k := key(line)) >= 10:
                first[k] = min(first.get(k, last), last if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] >= (last if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 7])
def test_lines_against_brute_force(spark, batches):
    r = random.Random(batches)
    pool = ["  A repeated Line \t", "a repeated line", "short", "éééééééééé", "ÉÉÉÉÉÉÉÉÉÉ", "", "tenletters", "nineletrs"] + [f"own line number {i}" for i in range(40)]
    rows = [(r.choice([i, i, 5, None]), "\n".join(r.choice(pool) for _ in range(r.randint(0, 9)))) for i in range(120)] + [(r_[0], r_[1]) for r_ in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("x")).withColumn("h1", F.lit(1))
    out = linededup.dedup_lines(docs, batches=batches)
    assert out.columns == ["doc_id", "text", "h1", "n_lines", "n_dropped"]
    assert sorted(((x.doc_id, x.n_lines, x.n_dropped, x.text) for x in out.collect()), key=repr) == brute_lines(rows)


def test_runs_are_merged_in_levels(spark):
    runs = linededup.LineRuns(spark)
    for i in range(7):
        runs.add(spark.createDataFrame([(i, f"a line of number {i}\nthe line of all")], "id long, text string"))
    assert [len(x) for x in runs.levels] == [1, 2]
    assert runs.known().count() == 8


def test_lines_of_no_rows(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while True:
        level = left / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > cap * sizes[s]]
        if not over:
            return target | {s: level * w[s] for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            free.discard(s)
            left -= target[s]


def test_mix_meets_its_targets(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.randint(0, 60), r.choice(["a", "a", "a", "b", "c", None, "é", "z"]), "en") for i in range(3_000)]
    out = mixing.decide(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes = Counter()
    for x in out:
        sizes[x.source] += x.size * x.n_rows
        assert 0 <= x.copies <= 2
    want, taken = brute_targets(dict(sizes)), Counter()
    for x in out:
        taken[x.source] += x.copies * x.size * x.n_rows
        assert x.target == pytest.approx(want[x.source]) and x.source_size == sizes[x.source]
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], abs=60)
    again = mixing.decide(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))


def test_mix_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumn("size", F.lit("x")).withColumn("copies", F.lit(9))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    counts = Counter((x.doc_id, x.source) for x in mixed.collect())
    assert all(n <= 2 for n in counts.values()) and (1, "s") not in counts
    assert mixing.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.decide(docs, share=3.0)


def test_language_of_odd_rows(spark):
    train = [(i, w * 40, "s", lang) for i, (w, lang) in enumerate([("the cat and a dog ", "en"), ("der hund und die katze ", "de")] * 5)]
    docs = spark.createDataFrame(train + ODD + [(50, "12 34 !!", "s", "en"), (51, "der hund und eine katze", "s", "xx")], SCHEMA).withColumn("score", F.lit("x"))
    model = language.fit(docs.filter("lang IN ('en', 'de')"))
    out = language.identify(docs, model)
    assert out.columns == ["doc_id", "text", "source", "lang", "lang_pred", "score", "rejected"]
    got = {x.doc_id: x for x in out.collect()}
    assert got[0].lang_pred == "en" and got[1].lang_pred in ("de", "und") and got[51].lang_pred == "de"
    for i in (2, 50):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert all(0 <= x.score <= 1 for x in got.values())
    assert {x.lang_pred for x in language.identify(docs, {}).collect()} == {"und"}
    assert {x.lang_pred for x in language.identify(docs, {"en": b"text"}).collect()} == {"und", "en"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_language_accuracy_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", language.held_out())
    model = language.fit(docs.filter("NOT held_out"))
    rows = language.identify(docs.filter("held_out"), model).select("doc_id", "lang", "lang_pred", "held_out").collect()
    assert all(zlib.crc32(str(x.doc_id).encode()) % 3 == 1 for x in rows)
    assert sum(x.lang == x.lang_pred for x in rows) / len(rows) > 0.95


def luhn(digits):
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def brute_pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]


def test_pii_against_plain_patterns(spark):
    r = random.Random(4)
    parts = list("aZ0159..@@--+ ()_%é😀") + ["1.2.3.4", "4111 1111 1111 1111", "+1 (555) 123-4567", "a@b.co", "0255.1.1.1"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 40)))) for i in range(1_500)] + [(-1, None), (-2, "1.2.3.4 " * 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pii", F.lit(0)).repartition(8)
    got = {x.doc_id: [(s.kind, s.start, s.end) for s in x.pii if s.kind != "iban"] for x in pii.find_pii(docs).drop("text").collect()}
    for i, text in rows:
        assert got[i] == brute_pii(text or ""), text
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_pii_is_linear_in_long_runs(spark):
    rows = [("a" * 60_000,), ("a@" * 30_000,), ("1." * 30_000,), ("1 " * 30_000,), ("+1((" * 20_000,), ("a.b@" + "c." * 30_000,)]
    assert pii.find_pii(spark.createDataFrame(rows, "text string")).count() == len(rows)


def test_iban_and_context(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32", "x GB82WEST12345698765433", "ref DE89370400440532013000."]
    spans = [x.pii for x in pii.find_pii(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).collect()]
    kinds = [[(s.kind, round(s.score, 2)) for s in row if s.kind == "iban"] for row in spans]
    assert kinds == [[("iban", 0.9)], [], [("iban", 0.8)]]


def test_pipeline_stages_keep_whole_rows(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    words = [f"word{i}" for i in range(900)]
    r = random.Random(1)
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = text(80)
    rows = [(i, text(60), f"s{i % 3}", "en") for i in range(20)] + [(30, base, "s1", "en"), (31, base + " more", "s2", "en"), (32, "...", "s1", "en"), (33, None, "s1", "en")]
    spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs)
    ids = [Counter(x.doc_id for x in d.collect()) for d in seen]
    assert set(ids[0]) == {*range(20), 30, 31} == set(ids[1]) and set(ids[2]) == {*range(20), 30}
    assert all(d.columns == ["doc_id", "text", "source", "lang", "n_chars"] for d in seen[:-1])
    assert ids[3] == ids[4] and max(ids[3].values()) <= 2
    assert all(x.decoded == x.text for x in seen[-1].collect())
    whole = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens").collect()
    assert Counter(x.doc_id for x in whole) == ids[4]


def test_digest_columns(spark):
    from parityflow.llm import queries

    got = {x.doc_id: x for x in queries.op9_pii(spark, "/root/testdata/sf0.001").collect()}
    for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_pii(x.text))
        assert got[x.doc_id].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()


def checked_iban(country, rest):
    value = int("".join(str(int(c, 36)) for c in f"{rest}{country}00"))
    return f"{country}{98 - value % 97:02d}{rest}"


def brute_iban(text):
    length = {c: n + 4 for n, codes in pii.IBAN_REST.items() for c in codes.split()}
    out, at = [], 0
    while at < len(text):
        m = re.compile(r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9])*").match(text, at)
        if m and (not at or not re.match("[A-Za-z0-9]", text[at - 1])) and m.group()[:2] in length:
            for end in range(at + 1, m.end() + 1):
                plain = text[at:end].replace(" ", "")
                if len(plain) == length[m.group()[:2]] and text[end - 1] != " " and not re.match("[A-Za-z0-9]", text[end : end + 1]):
                    if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                        out.append((at, end))
                        at = end - 1
                    break
        at += 1
    return out


def test_ibans_with_words_behind_them_against_brute_force(spark):
    r = random.Random(8)
    texts = ["pay DE89370400440532013000 Please", "IBAN DE89 3704 0044 0532 0130 00 The next", "GB82WEST12345698765432 2 times", "ZZ12 3456 7890 123 DE89370400440532013000 A"]
    for n, codes in pii.IBAN_REST.items():
        for code in codes.split():
            iban = checked_iban(code, "".join(r.choice("0123456789ABCXYZ") for _ in range(n)))
            grouped = " ".join(iban[i : i + 4] for i in range(0, len(iban), 4))
            texts += [f"{a} {b}{c}" for a, b, c in zip(("to", "X", "é:"), (iban, grouped, grouped), (" Please pay", f" A {grouped} 2 TIMES", r.choice(["x", "9", ".", " 12", ", IBAN"])))]
    got = [[(s.start, s.end) for s in x.pii if s.kind == "iban"] for x in pii.find_pii(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).collect()]
    assert [len(x) for x in got[:4]] == [1, 1, 1, 1]
    for text, spans in zip(texts, got):
        assert spans == brute_iban(text), text
