import pytest
from pyspark.sql import functions as F

from lakeloom.errors import DataLoaderError
from lakeloom.operators import blocks as B
from lakeloom.operators import instruct as I


def test_shifted_blocks(spark):
    stream = spark.range(40).select(F.col("id").alias("pos"), F.col("id").alias("token_id"))
    rows = B.batches(stream, 4, 1).orderBy("batch_id").collect()
    assert rows[0]["x"] == [0, 1, 2, 3] and rows[0]["y"] == [1, 2, 3, 4] and rows[1]["x"][0] == 5
    assert len(rows) == B.epoch_batches(40, 4, 1) == 8
    assert B.batches(stream, 4, 3).count() == 6  # whole batches only


def test_config():
    assert [B.LoaderConfig(t, b).buffer for b, t in ((2, 4), (3, 5), (4, 6), (5, 7))] == [10000, 10000, 14000, 20000]
    for bad in ((4, 2, 9), (0, 2, None), (4, 0, None)):
        with pytest.raises(DataLoaderError):
            B.LoaderConfig(*bad)
    assert [B.token_type(n) for n in (256, 257, 65535, 65536)] == ["uint8", "uint16", "uint16", "uint32"]
    with pytest.raises(ValueError):
        B.token_type(1 << 33)


def test_refill():
    assert [p[0] for p in B.refill_starts(100, 16, 5, 7)] == [0, 5, 10, 16, 21, 26, 32]
    assert B.refill_starts(12, 24, 5, 3)[2] == [10, 11, 0, 1, 2]


def test_refill_runs():
    for n in range(1, 60):
        for buffer in range(1, 25):
            for need in range(1, buffer + 1):
                runs, period = B.refill_runs(n, buffer, need, 40)
                starts = {b + i * k + j: (at + i * stride + j * need) % n for b, k, q, stride, at in runs for i in range(q) for j in range(k)}
                assert [starts[b % period] for b in range(40)] == [p[0] for p in B.refill_starts(n, buffer, need, 40)]


@pytest.mark.parametrize("buffer,count", [(8, None), (23, None), (23, 40), (64, None), (64, 25), (100, 25), (700, 9)])
def test_refill_batches_of_documents(spark, buffer, count):
    ids = list(range(1000, 1064))
    cuts = [0, 3, 3, 14, 15, 22, 62, 64]
    docs = spark.createDataFrame([(k, ids[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))], "doc_id long, token_ids array<int>").repartition(3)
    config = B.LoaderConfig(3, 2, buffer)
    got = {(r["batch_id"], r["row"]): (r["x"], r["y"]) for r in B.refill_batches(B.positions(docs, "doc_id"), 64, config, count).collect()}
    want = {}
    for b, places in enumerate(B.refill_starts(64, buffer, 8, 8 if count is None else count)):
        for row in range(2):
            own = [ids[p] for p in places[row * 4 : row * 4 + 4]]
            want[b, row] = (own[:-1], own[1:])
    assert got == want


def test_refill_query_is_a_whole_epoch(spark):
    from lakeloom.plans.token_queries import _stream, refill_batches

    sf = "/root/testdata/sf0.001"
    n = int(_stream(spark, sf).agg(F.sum("n")).first()[0])
    rows = refill_batches(spark, sf)
    assert rows.count() == rows.select("batch_id", "row").distinct().count() == 4 * B.epoch_batches(n, 64, 4)


def test_collate(spark):
    df = spark.createDataFrame([(0, 0, [1, 2, 3]), (0, 1, [4]), (1, 2, [5, 9, 6, 7])], "b long, k long, ids array<int>")
    got = {r["k"]: (r["inputs"], r["targets"]) for r in B.collate(df, "b", "ids", pad=9).collect()}
    assert got[0] == ([1, 2, 3], [2, 3, 9]) and got[1] == ([4, 9, 9], [9, -100, -100])
    assert got[2] == ([5, 9, 6, 7], [9, 6, 7, -100])
    short = {r["k"]: r["inputs"] for r in B.collate(df, "b", "ids", pad=9, longest=3).collect()}
    assert short[0] == [1, 2]


def test_collate_whole_samples(spark):
    from lakeloom.plans.instruct_queries import _numbered, collate_samples

    df = spark.createDataFrame([(0, 0, list(range(3000))), (0, 1, [4])], "b long, k long, ids array<int>")
    got = {r["k"]: (r["inputs"], r["targets"]) for r in B.collate(df, "b", "ids", pad=9000, longest=None).collect()}
    assert got[0] == (list(range(3000)), [*range(1, 3000), 9000])
    assert got[1] == ([4] + [9000] * 2999, [9000] + [-100] * 2999)
    sf = "/root/testdata/sf0.001"
    sample = {r["pos"]: r["s"] for r in _numbered(spark, sf).select("pos", I.format_sample().alias("s")).collect()}
    rows = {r["pos"]: r for r in collate_samples(spark, sf).collect()}
    assert set(rows) == set(sample)
    for pos, text in sample.items():
        size = max(len(t) for p, t in sample.items() if p // 8 == pos // 8)
        full = [ord(c) for c in text] + [50256] * (size + 1 - len(text))
        targets = [x if i <= len(text) - 1 else -100 for i, x in enumerate(full[1:])]
        assert (rows[pos]["n"], rows[pos]["input_sum"], rows[pos]["target_sum"]) == (size, sum(x * i for i, x in enumerate(full[:-1], 1)), sum(x * i for i, x in enumerate(targets, 1)))


def test_fraction_split(spark):
    got = {r["split"]: r["count"] for r in B.fraction_split(spark.range(40), "id", 40).groupBy("split").count().collect()}
    assert got == {"train": 34, "test": 4, "val": 2}


def test_blocks_of_documents(spark):
    docs = spark.createDataFrame([(k, list(range(k * 100, k * 100 + n))) for k, n in enumerate([3, 0, 11, 1, 7, 40, 2])], "doc_id long, token_ids array<int>")
    placed = B.positions(docs, "doc_id")
    for t, b in ((4, 1), (4, 3), (2, 2), (30, 1)):
        a = sorted(map(str, B.batches_of(placed, t, b).collect()))
        assert a == sorted(map(str, B.batches(B.long_tokens(placed), t, b).collect()))


def test_sample_batches(spark):
    df = spark.range(10)
    got = B.sample_batches(df, "id", 3, 10, drop_last=True, seed=1).collect()
    assert len(got) == 9 and sorted((r["batch_id"], r["row"]) for r in got) == [(b, k) for b in range(3) for k in range(3)]
    assert B.sample_batches(df, "id", 3, 10).where("batch_id = 3").count() == 1


@pytest.mark.parametrize("code,keys", [("u1", 1), ("<i4", 1), ("<u2", 977)])
def test_packed_batches(spark, code, keys):
    import numpy as np

    r = np.random.default_rng(5)
    docs = [(k * keys - 300, r.integers(0, 200, int(n)).astype(code)) for k, n in enumerate(r.choice([0, 1, 2, 7, 40, 900], 700))]
    stream = np.concatenate([x for _, x in docs])
    df = spark.createDataFrame([(k, bytearray(x.tobytes()), 1, "b") for k, x in docs] + [(10**7, None, 1, "b")], "k long, raw binary, start long, block string").repartition(5)
    got = {(x["batch_id"], x["row"]): (x["x"], x["y"]) for x in B.packed_batches(df, "k", F.col("raw"), 16, 3, code).collect()}
    n = len(stream) // 51
    assert sorted(got) == [(b, i) for b in range(n) for i in range(3)]
    for (b, i), (x, y) in got.items():
        row = stream[(3 * b + i) * 17 :][:17].tolist()
        assert x == row[:-1] and y == row[1:]
    assert B.packed_batches(df.limit(0), "k", F.col("raw"), 16, 3, code).count() == 0
