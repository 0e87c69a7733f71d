import regex
import pytest
from pyspark.sql import functions as F

from lakeloom.errors import TokenizerError
from lakeloom.functions.text import GPT4_PATTERN
from lakeloom.operators import bpe as P

from .test_text import column, fuzz

SENTENCE = "Hello world! This is a test. Hello everyone."


def train(spark, text, size, **options):
    return P.train(spark.createDataFrame([(0, text)], "o long, text string"), "o", size, **options)


def slow_train(text, size):
    """Brute force: recount everything for each merge, first seen wins."""
    words = [list(w.encode()) for w in regex.findall(GPT4_PATTERN, text)]
    merges = []
    while len(merges) < size - 256:
        total = {}
        for w in words:
            own = {}
            for p in zip(w, w[1:]):
                own[p] = own.get(p, 0) + 1
            for p, n in sorted(own.items(), key=lambda x: -x[1]):
                total[p] = total.get(p, 0) + n
        if not total:
            break
        best = max(total, key=total.get)
        merges.append(best)
        words = [_merge(w, best, 255 + len(merges)) for w in words]
    return merges


def _merge(w, pair, new):
    out, i = [], 0
    while i < len(w):
        if i + 1 < len(w) and (w[i], w[i + 1]) == pair:
            out.append(new)
            i += 2
        else:
            out.append(w[i])
            i += 1
    return out


def test_merges_of_the_sentence(spark):
    assert [len(train(spark, SENTENCE, n).merges) for n in (256, 260, 280, 300)] == [0, 4, 24, 28]
    assert train(spark, SENTENCE, 300).merges == slow_train(SENTENCE, 300)
    with pytest.raises(TokenizerError):
        train(spark, SENTENCE, 255)


def test_distributed_training_agrees(spark):
    text = " ".join(fuzz(30, 5))
    a, b = train(spark, text, 280), train(spark, text, 280, on_driver=0)
    assert a.merges == b.merges == slow_train(text, 280)


def test_encode_decode(spark):
    text = "the cat sat on the mat, the cat's hat. " * 5
    bpe = train(spark, text, 300)
    bpe.specials = {"<|a|>": 1000, "<|endoftext|>": 100257}
    texts = fuzz(200, 6) + ["", " ", "\n", "x<|endoftext|>y<|a|><|a|>", "<|endoftext|>", "the cat"]
    ranks = {p: k for k, p in enumerate(bpe.merges)}

    def slow(t):
        out = []
        for piece in regex.split(r"(<\|a\|>|<\|endoftext\|>)", t):
            out += [bpe.specials[piece]] if piece in bpe.specials else [i for w in regex.findall(GPT4_PATTERN, piece) for i in P.merge_word(list(w.encode()), ranks)]
        return out

    ids = column(spark, texts, P.encode(F.col("t"), bpe))
    assert ids == [slow(t) for t in texts]
    back = spark.createDataFrame(list(enumerate(ids)), "i long, t array<int>").select("i", P.decode(F.col("t"), bpe).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in back] == texts
    assert bpe.specials["<|endoftext|>"] in ids[-2]


def test_unknown_id_and_bad_bytes(spark):
    bpe = train(spark, SENTENCE, 260)
    with pytest.raises(Exception, match="Unknown token ID"):
        spark.createDataFrame([([999999],)], "t array<int>").select(P.decode(F.col("t"), bpe)).collect()
    assert spark.createDataFrame([([255, 65],)], "t array<int>").select(P.decode(F.col("t"), bpe).alias("x")).first()["x"] == "�A"


def test_naive(spark):
    bpe = P.train(spark.createDataFrame([(0, "aaabdaaabac")], "o long, text string"), "o", 259, pattern=None)
    assert len(bpe.merges) == 3 and bpe.merges[0] == (97, 97)
    assert column(spark, ["aaab"], P.naive_encode_compat(F.col("t"))) == [[97, 97, 97, 98]]
    ranks = {p: k for k, p in enumerate(bpe.merges)}
    assert column(spark, ["aaabdaaabac"], P.naive_encode(F.col("t"), bpe)) == [P.merge_word(list(b"aaabdaaabac"), ranks)]


def test_files(spark):
    bpe = train(spark, SENTENCE, 280, specials={"<|x|>": 500})
    assert P.Bpe.from_json(bpe.to_json()) == bpe
    strict = P.Bpe.from_json(bpe.to_json(strict=True))
    assert strict.merges == bpe.merges and strict.specials == {}
    text = bpe.readable()
    assert "BPE Tokenizer - 280 tokens" in text and " 10: \\u000a" in text and f"[{bpe.merges[0][0]}] + [{bpe.merges[0][1]}] -> [" in text
    assert P.render(b"\xff\xfe") == "\\xff \\xfe" and P.render(b"Hello\n\t") == "Hello\\u000a\\u0009"
    with pytest.raises(TokenizerError):
        P.make_tokenizer("regex_bpe").to_json()
    with pytest.raises(ValueError):
        P.make_tokenizer("simple_tokenizer")


def test_pair_counts(spark):
    counts = spark.createDataFrame([("\x01\x02\x02\x03\x02\x02", 0, 0, 1)], "chunk string, first_text long, first_pos int, n long")
    got = {tuple(map(ord, r["pair"])): r["total"] for r in P.pair_counts(counts).collect()}
    assert got == {(2, 2): 2, (1, 2): 1, (2, 3): 1, (3, 2): 1}
    assert tuple(map(ord, P.most_frequent_pair(counts)["pair"])) == (2, 2)


def test_distinct_chunks(spark):
    bpe = P.Bpe(train(spark, SENTENCE, 280).merges)
    df = spark.createDataFrame(list(enumerate(["Hello test", "world! Hello"])), "k long, text string")
    a = {r["k"]: r["token_ids"] for r in df.select("k", P.encode_cached(F.col("text"), bpe).alias("token_ids")).collect()}
    b = {r["k"]: r["x"] for r in df.select("k", P.encode(F.col("text"), bpe).alias("x")).collect()}
    assert a == b


def test_published_ranks(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(0, "hello world"), (1, "")], "k long, text string")
    got = {r["k"]: r["token_ids"] for r in P.tiktoken_encode(df, ["k"], open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), tokenizers.PATTERN, {"<|endoftext|>": 50256}).collect()}
    assert len(got[0]) == 2 and got[1] == []


def test_encoder_forgets(spark):
    """What is remembered is bounded, and does not change ids."""
    bpe = train(spark, "the cat sat on the mat " * 3, 280)
    text = " ".join(fuzz(60, 9))
    assert P.Encoder(bpe, most=2).ids(text) == P.Encoder(bpe).ids(text)


def test_published_ranks_as_merges():
    import tiktoken
    import public_tokenizers as tokenizers

    ranks = P.read_ranks(open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    bpe = P.from_ranks(ranks, P.GPT4_PATTERN, most=3000)
    kept = {t: r for t, r in ranks.items() if len(t) == 1} | {t: 256 + k for k, t in enumerate(t for _, t in sorted((r, t) for t, r in ranks.items() if len(t) > 1)[:3000])}
    other = tiktoken.Encoding("own", pat_str=P.GPT4_PATTERN, mergeable_ranks=kept, special_tokens={})
    own = {i: b for i, b in bpe.vocabulary.items()}
    for text in [*fuzz(100, 3), "the quick brown foxes jumped over lazy dogs' houses"]:
        assert [own[i] for i in P.Encoder(bpe).ids(text)] == [other.decode_single_token_bytes(i) for i in other.encode_ordinary(text)]


def test_decoding_by_arrays(spark):
    bpe = train(spark, "the cat sat on the mat " * 9, 290)
    bpe.specials = {"<|a|>": 1000, "<|endoftext|>": 100257, "<|same|>": 97}
    ids = [[1000, 116, 256, 100257], [], None, [0xFF, 0xC3, 97], [255 + len(bpe.merges)], list("é中".encode()), [100257]]
    df = spark.createDataFrame(list(enumerate(ids)), "i long, t array<int>").repartition(2)
    got = [r["x"] for r in df.select("i", P.decode_cached(F.col("t"), bpe).alias("x")).orderBy("i").collect()]
    want = [r["x"] for r in df.select("i", P.decode(F.col("t"), bpe).alias("x")).orderBy("i").collect()]
    assert got == want and got[2] is None and got[1] == ""
    assert df.limit(0).select(P.decode_cached(F.col("t"), bpe)).count() == 0
    for bad in ([256 + len(bpe.merges)], [-1], [999999], [None]):
        with pytest.raises(Exception, match="Unknown token ID"):
            spark.createDataFrame([(bad,)], "t array<int>").select(P.decode_cached(F.col("t"), bpe)).collect()


def test_whole_published_vocabulary(spark):
    """Tokens of all merges, as bytes, are those of an independent encoder."""
    tiktoken = pytest.importorskip("tiktoken")
    from lakeloom.plans.token_queries import published, published_bpe

    ranks = P.read_ranks(published())
    other = tiktoken.Encoding("own", pat_str=GPT4_PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = published_bpe()
    vocabulary = bpe.vocabulary
    assert len(vocabulary) == len(ranks)
    texts = fuzz(60, 8) + ["x" * 5000 + " 12345678901234567890", "Ünïcödé 中文 " * 50]
    for t, ids in zip(texts, column(spark, texts, P.encode_cached(F.col("t"), bpe)), strict=True):
        assert [vocabulary[i] for i in ids] == other.decode_tokens_bytes(other.encode(t))


def test_sql_without_a_file(monkeypatch):
    from lakeloom.plans import registry, token_queries

    monkeypatch.setenv("LAKELOOM_TOKENIZERS", "/nowhere")
    token_queries.large_bpe.cache_clear(), token_queries.published_bpe.cache_clear()
    got = registry.oracles()
    assert "bpe_encode" in got and "published_encode" not in got
    monkeypatch.delenv("LAKELOOM_TOKENIZERS")
    assert "published_encode" in registry.oracles()


def test_workers_hand_on_pieces_of_a_batch(spark):
    """What a worker makes of a batch of texts does not grow with the batch."""
    import pyarrow as pa

    from lakeloom.functions import text as T

    texts = ["ab" * (1 << 17) if i % 3 else None for i in range(30)] + ["", "é" * (T.PIECE + 1)]
    pieces = list(T.pieces_of(iter([pa.array(texts), pa.array([], pa.string())])))
    assert [x for p in pieces for x in p.to_pylist()] == texts and max(p.nbytes for p in pieces[:-2]) <= T.PIECE + (1 << 18) and len(pieces) > 4
    lists = [[i] * 100_000 for i in range(20)] + [None]
    pieces = list(T.pieces_of(iter([pa.array(lists, pa.list_(pa.int32()))])))
    assert [x for p in pieces for x in p.to_pylist()] == lists and len(pieces) > 9
    made = list(T._bytes_of(iter([pa.array([t or "" for t in texts])])))
    assert len(made) > 4 and [len(x) for m in made for x in m.to_pylist()] == [len((t or "").encode()) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    tokenizer = P.Bpe([(97, 98), (256, 256)], {})
    back = rows.select("i", "t", P.decode_cached(P.encode_cached(F.col("t"), tokenizer), tokenizer).alias("x")).collect()
    assert len(back) == len(texts) and all(r["t"] == r["x"] == texts[r["i"]] for r in back)


def test_chunks_are_counted_without_sorting_them(spark):
    """First places are one integer where they fit; numbers of texts that do not fit, or are null, give the same."""
    texts = [t for t in fuzz(200, 9)] + ["a a a b", "b a"]
    for numbers in ([5 * i - 300 for i in range(202)], [(i - 100) << 40 for i in range(202)], [None, *range(201)], [(1 << 32) - 1 - i for i in range(202)], [i - (1 << 32) for i in range(202)]):
        df = spark.createDataFrame(list(zip(numbers, texts, strict=True)), "k long, text string").repartition(3)
        counts = P.chunk_counts(df, "k")
        assert P.packs(df, "k") == (None not in numbers and max(numbers) < 1 << 32)
        assert ("SortAggregate" in counts._jdf.queryExecution().executedPlan().toString()) != P.packs(df, "k")
        want = {}
        for k, t in sorted(zip(numbers, texts, strict=True), key=lambda x: (x[0] is not None, x[0])):
            for i, c in enumerate(regex.findall(GPT4_PATTERN, t)):
                want.setdefault(c.encode().decode("latin-1"), [k, i, 0])[2] += 1
        assert {r["chunk"]: [r["first_text"], r["first_pos"], r["n"]] for r in counts.collect()} == want
    assert P.chunk_counts(df.limit(0), "k").count() == 0
