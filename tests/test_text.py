import random

import pytest
import regex
from pyspark.sql import functions as F

from lakeloom.errors import TokenizerError
from lakeloom.functions import text as T
from lakeloom.functions.words import word_tokens
from lakeloom.operators import documents as D
from lakeloom.operators import wordvocab as V


def fuzz(n, seed=0):
    r = random.Random(seed)
    plain = "ab Z9'.,!?\t\n\r-_tsdm're  "
    wide = plain + "éßñĳ中日한  　́😀٣Ⅷ\x1c\x1f​"
    return ["".join(r.choice(plain if i % 2 else wide) for _ in range(r.randint(0, 40))) for i in range(n)]


def column(spark, texts, expr):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", expr.alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


@pytest.mark.parametrize("pattern", [T.GPT2_PATTERN, T.GPT4_PATTERN])
def test_chunks_match_regex(spark, pattern):
    texts = fuzz(1500)
    assert column(spark, texts, T.chunks(F.col("t"), pattern)) == [regex.findall(pattern, t) for t in texts]


def test_words_match_regex(spark):
    texts = fuzz(1500, 1)
    assert column(spark, texts, word_tokens(F.col("t"))) == [regex.findall(r"\w+(?:'\w+)*|[^\w\s]", t) for t in texts]


def test_strip_and_split(spark):
    texts = fuzz(800, 2) + ["a\n\n\nb", "\n\n", "", "a\n \nb"]
    assert column(spark, texts, T.strip(F.col("t"))) == [t.strip() for t in texts]
    assert column(spark, texts, T.split_array(F.col("t"), "double_newline")) == [[p.strip() for p in regex.split(r"\n{2,}", t) if p.strip()] for t in texts]
    assert column(spark, texts, T.split_array(F.col("t"))) == [[t] for t in texts]
    assert column(spark, ["a--SEP--b", "x"], T.split_array(F.col("t"), "regex", "--SEP--")) == [["a", "b"], ["x"]]


def test_byte_ids(spark):
    texts = fuzz(300, 3)
    assert column(spark, texts, T.byte_ids(F.col("t"))) == [list(t.encode()) for t in texts]


def test_splitter_errors():
    for bad in (lambda: T.split_array(F.lit("a"), "regex"), lambda: T.split_array(F.lit("a"), "lines"), lambda: T.split_array(F.lit("a"), "regex", "(a)"), lambda: T.split_array(F.lit("a"), "regex", "")):
        with pytest.raises(ValueError):
            bad()


def test_seeded_shuffle(spark):
    docs = spark.createDataFrame([("k", 0, "First"), ("k", 1, "Second"), ("k", 2, "Third")], "key string, doc_pos int, doc string")
    got = [r["doc"] for r in D.shuffled(docs, "key", 42).orderBy("doc_pos").collect()]
    assert got == ["Second", "First", "Third"]
    assert D.permutation(1, 42) == [0]
    assert D.hash_shuffled(docs, 1, "doc").count() == 3


def test_split_in_order_is_the_split_of_the_joined_texts(spark):
    """Documents of a key come from its rows: no task holds the text of a key, and an order may be of more than 2**20 documents."""
    ends = ["", "\n", "\n\n", "\n\n\n", " \n", "\n \n"]
    r = random.Random(3)
    texts = [None if i % 17 == 0 else r.choice(ends) + "\n\n".join(r.choice(["ab", "c\nd", "", " e ", "long enough"]) for _ in range(r.randint(0, 5))) + r.choice(ends) for i in range(300)]
    rows = [(r.choice(["x", "y", None]), i * 977 - 40, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k string, no long, doc string").repartition(5)
    for least in (0, 3):
        want = {}
        for k in ("x", "y", None):
            pieces = [p.strip() for p in regex.split(r"\n{2,}", "\n\n".join(t for key, _, t in rows if key == k and t is not None)) if p.strip()]
            want[k] = [p for p in pieces if len(p) >= least]
        got = D.split_in_order(df, "k", "no", "doc", min_chars=least).collect()
        assert sorted((str(x["k"]), x["doc_pos"], x["doc"]) for x in got) == sorted((str(k), i, p) for k, ps in want.items() for i, p in enumerate(ps))
        got = D.split_in_order(df, "k", "no", "doc", min_chars=least, shuffle=True, seed=42).collect()
        assert sorted((str(x["k"]), x["doc_pos"], x["doc"]) for x in got) == sorted((str(k), i, ps[o]) for k, ps in want.items() for i, o in enumerate(D.permutation(len(ps), 42)))
    assert D.split_in_order(df.limit(0), "k", "no", "doc", shuffle=True, seed=1).count() == 0
    order = list(range(1000))
    random.Random(7).shuffle(order)
    assert D.permutation(1000, 7) == order


def test_shuffled_has_no_most(spark):
    n = (1 << 20) + 5
    docs = spark.range(n).select(F.lit(None).cast("string").alias("key"), F.col("id").cast("int").alias("doc_pos"), F.col("id").alias("doc"))
    got = D.shuffled(docs, "key", 42)
    assert got.agg(F.count(F.lit(1)), F.countDistinct("doc_pos"), F.max("doc_pos")).first()[:] == (n, n, n - 1)
    assert [r["doc"] for r in got.where("doc_pos < 3").orderBy("doc_pos").collect()] == D.permutation(n, 42)[:3]


def test_split_documents_min_length(spark):
    df = spark.createDataFrame([(1, "one line\n\nshort\n\nanother line here")], "k long, text string")
    rows = D.split_documents(df, "k", method="double_newline", min_chars=8).orderBy("doc_pos").collect()
    assert [(r["doc_pos"], r["doc"]) for r in rows] == [(0, "one line"), (1, "another line here")]
    joined = D.join_documents(D.split_documents(df, "k", method="double_newline", min_chars=0), "k").first()["text"]
    assert joined == "one line\n\nshort\n\nanother line here"


def test_vocabulary(spark):
    df = spark.createDataFrame([("hello hello world test",)], "text string")
    got = {r["token"]: r["id"] for r in V.build_vocabulary(df, min_frequency=2).collect()}
    assert got == {"hello": 0, "<|UNK|>": 1, "<|endoftext|>": 2}
    vocab = V.build_vocabulary(df)
    ids = V.encode_words(spark.createDataFrame([(1, "hello there")], "k long, text string"), vocab, ["k"])
    assert [r["token_id"] for r in ids.orderBy("pos").collect()] == [0, 3]
    assert V.decode_words(ids, vocab, ["k"]).first()["text"] == "hello <|UNK|>"
    with pytest.raises(TokenizerError):
        V.check_vocabulary(vocab.where("id < 0"))


def test_prefix_sum_of_sparse_keys(spark):
    from lakeloom.operators.ranking import prefix_sum

    keys = [-(2**50), -7, 0, 1, 5000, 2**40, 2**60]
    got = {r["k"]: r["s"] for r in prefix_sum(spark.createDataFrame([(k, 10 + i) for i, k in enumerate(keys)], "k long, v long").repartition(3), "k", "v", "s").collect()}
    assert got == {k: sum(10 + j for j in range(i)) for i, k in enumerate(keys)}
    assert prefix_sum(spark.createDataFrame([], "k long, v long"), "k", "v", "s").count() == 0


def test_prefix_sum_and_ranks(spark):
    from lakeloom.operators.ranking import prefix_sum, rank_strings

    rows = spark.createDataFrame([(k, k % 5) for k in range(0, 30000, 7)], "k long, v long")
    got = {r["k"]: r["s"] for r in prefix_sum(rows, "k", "v", "s").collect()}
    total = 0
    for k in range(0, 30000, 7):
        assert got[k] == total
        total += k % 5
    words = sorted({"".join(random.Random(i).choices("abé😀", k=4)) for i in range(200)}, key=lambda s: s.encode())
    got = {r["w"]: r["r"] for r in rank_strings(spark.createDataFrame([(w,) for w in words], "w string"), "w", "r").collect()}
    assert got == {w: i for i, w in enumerate(words)}
