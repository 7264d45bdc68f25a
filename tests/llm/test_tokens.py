"""BPE and edit-aware counts against the tokenizers library."""

import random
from collections import Counter

import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from parityflow.llm import bpe, edits  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

PATH = public.path("byte_bpe_50k.json")
ODD = [chr(i) for i in (9, 10, 13, 32, 133, 160, 0x558, 0x1C89, 0x2028, 0x3000, 0x1F600, 0x33000)] + list("aZé9ßñ.,!") + ["'s", "'re", "'r", " x", "  ", "<|endoftext|>", "thing"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary(PATH)


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ODD + [" "] * 8) for _ in range(r.randint(0, 80))) for _ in range(n)]


def test_codec_is_the_library(library, vocabulary):
    v = bpe.Vocabulary(vocabulary)
    frequent = {w.encode(): v.merge(w.encode()) for w in (" thing", "thing", " x", "'s", "é")}
    codec = bpe.Codec(vocabulary, bpe.Lexicon.build(frequent))
    for text in texts(2_000, 1):
        want = library.encode(text, add_special_tokens=False).ids
        ids = codec.encode(text)
        assert list(memoryview(ids).cast("I")) == want, text
        assert codec.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_frequent_pieces_outlive_rare_ones(library, vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 30)
    codec, asked = bpe.Codec(vocabulary, bpe.Lexicon.build({})), []
    find, codec.find = codec.find, lambda w: asked.append(w) or find(w)
    rare = ["".join(random.Random(i).choices("abcdeé", k=6)) + str(i % 3) * (i % 2) for i in range(200)]
    text = "start often, often, " + " ".join(f"{w} often," for w in rare) + " often"
    for t in (text, "often often, \u0559x\u0558 \u0559x\u0558 '' ''", "a\noften, a\noften, a\noften"):
        ids = codec.encode(t)
        want = library.encode(t, add_special_tokens=False).ids
        assert list(memoryview(ids).cast("I")) == want
        assert codec.decode(ids) == library.decode(want, skip_special_tokens=False)
    assert asked.count(" often") <= 2 and asked.count(",") <= 2
    assert max(len(m) for memory in (codec.of_word, codec.of_piece) for m in (memory.kept, memory.new)) <= 20


def test_long_words_merge_like_short_ones(library, vocabulary):
    v = bpe.Vocabulary(vocabulary)
    for text in ("ab" * 400, "x" * 3_000, "antidisestablishment" * 20):
        assert v.merge(text.encode()) == library.encode(text, add_special_tokens=False).ids
        assert v._merge_long([v.of_byte[b] for b in text[:30].encode()]) == v.merge(text[:30].encode())


def test_lexicon_finds_its_words_only():
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["", "a", "ab", "nation", "station", "stations", "zz"])}
    lexicon = bpe.Lexicon(bpe.Lexicon.build(words))
    for w, ids in words.items():
        assert list(memoryview(lexicon.ids(lexicon.find(w))).cast("I")) == ids
    assert [lexicon.find(w) for w in (b"b", b"natio", b"stationss")] == [-1] * 3
    assert bpe.Lexicon(bpe.Lexicon.build({})).find(b"a") == -1


def test_round_trip_of_odd_rows(spark, vocabulary, library):
    rows = [(1, "a b c", "x"), (2, None, None), (3, "", "y"), (3, "", "y"), (4, "w" * 50_000 + " end", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    out = bpe.round_trip(docs, vocabulary, bpe.build_lexicon(docs, vocabulary))
    assert out.columns == ["doc_id", "text", "token_ids", "n_tokens", "decoded"]
    for r in out.collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.decoded) == (len(want), r.text or "")
        assert bytes(r.token_ids) == b"".join(i.to_bytes(4, "little") for i in want)
    back = bpe.decode(bpe.encode(docs, vocabulary, bpe.Lexicon.build({})), vocabulary).select("decoded").collect()
    assert sorted(r.decoded for r in back) == sorted(r[1] or "" for r in rows)
    assert bpe.round_trip(docs.limit(0), vocabulary, bpe.build_lexicon(docs.limit(0), vocabulary)).count() == 0


def test_lexicon_is_built_by_tasks(spark, vocabulary, monkeypatch):
    """The driver neither loads the vocabulary nor merges words; what it gets is the lexicon of the same words."""
    docs = spark.createDataFrame([(t,) for t in texts(300, 7)] + [(None,)], "text string").repartition(3)
    counts = Counter(w for t in texts(300, 7) for w in bpe.split_words(t))
    merge = bpe.Vocabulary(vocabulary).merge
    want = bpe.Lexicon.build({w.encode(): merge(w.encode()) for w, n in counts.items() if n > 1 and len(w.encode()) <= bpe.LEXICON_WORD_BYTES})

    def refuse(*_):
        raise AssertionError("on the driver")

    monkeypatch.setattr(bpe, "Vocabulary", refuse)
    monkeypatch.setattr(bpe.Lexicon, "build", refuse)
    assert bpe.build_lexicon(docs, vocabulary) == want


def test_word_counts_cover_all_texts(spark):
    docs = spark.createDataFrame([(t,) for t in texts(300, 5)] + [(None,)], "text string")
    want = {}
    for t in texts(300, 5):
        for w in bpe.split_words(t):
            want[w] = want.get(w, 0) + 1
    assert {r.word: r.n for r in bpe.word_counts(docs).collect()} == want


def test_sketched_counts_keep_frequent_words():
    r = random.Random(6)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(40_000)]
    exact, kept = Counter(words), Counter()
    for at in range(0, len(words), 500):
        kept.update(words[at : at + 500])
        kept = bpe.keep_frequent(kept, 200)
    off = len(words) // 200
    assert len(kept) <= 200
    assert all(n - off <= kept[w] <= n for w, n in exact.items() if n > off or w in kept)


def test_edits_count_like_the_library(library, vocabulary):
    counts, r = edits.TokenCounts(bpe.Codec(vocabulary, bpe.Lexicon.build({})), most=50), random.Random(3)
    whole = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    bits = ODD + [" "] * 4 + ["<|endof", "text|>", "<|", "|>"]
    for text in texts(60, 8) + ["one <|endoftext|> two", "word and more. " * 400, "it <|endoftext|> is " * 90, " " * 500 + "x", "a" * 900, ""]:
        tree = edits.document_tree(text, counts)
        assert tree.tokens == whole(text)
        for _ in range(25):
            a = r.choice([r.randint(0, len(tree.text)), max(0, tree.text.find("|endof"))])
            tree.edit(a, a + r.choice([0, 1, 3, 40]), "".join(r.choice(bits) for _ in range(r.choice([0, 1, 2, 30]))))
            assert tree.tokens == whole(tree.text)
            assert tree.sums[tree.size : tree.size + tree.n, 0].sum() == len(tree.text)


def test_an_edit_encodes_its_surroundings_only(vocabulary):
    codec = bpe.Codec(vocabulary, bpe.Lexicon.build({}))
    tree = edits.document_tree("some words of a long text. " * 5_000, edits.TokenCounts(codec))
    whole = tree.encoded_chars
    tree.edit(60_000, 60_010, "another thing")
    assert tree.encoded_chars - whole < 3_000


def test_edited_counts_of_odd_rows(spark, vocabulary, library):
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (None, "x y"), (3, ""), (3, "again")], "doc_id long, text string")
    todo = spark.createDataFrame(
        [(1, 2, 0, 3, "ten"), (1, 1, None, None, " four"), (2, 1, 5, 9, "new"), (9, 1, 0, 1, "q"), (None, 1, 0, 1, "q"), (3, 1, 0, 0, None)],
        "doc_id long, seq int, start long, finish long, new string",
    )
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_tokens_after) for r in edits.count_edited(docs, todo, vocabulary).collect())
    want = [(0, n("x y"), n("x y")), (1, n("one two three"), n("ten two three four")), (2, 0, n("new")), (3, 0, 0), (3, n("again"), n("again"))]
    assert got == sorted(want)
    assert edits.count_edited(docs.limit(0), todo, vocabulary).count() == 0


def test_counts_of_words_outlive_a_full_table(vocabulary):
    codec = bpe.Codec(vocabulary, bpe.Lexicon.build({w: bpe.Vocabulary(vocabulary).merge(w) for w in (b" thing", b" th", b"a")}))
    words = [" thing", " th", " thin", "a", "", "é", "thingsome", "\u4e2d\u6587x"]
    assert [codec.count(w) for w in words] == [len(codec.word(w)) // 4 for w in words]
    asked, counts = [], edits.TokenCounts(codec, 2)
    count, codec.count = codec.count, lambda w: asked.append(w) or count(w)
    assert [counts[w] for w in ("a", "bc", "def", "a", "bc")] == [1, count("bc"), count("def"), 1, count("bc")]
    assert asked == ["a", "bc", "def"]
