"""Lookups of skewed values."""

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import lookup
from lakeloom.operators import wordvocab as V


def test_heavy_values_and_nulls(spark):
    rows = spark.createDataFrame([(i, None if i % 50 == 0 else "the" if i % 2 else f"w{i}") for i in range(2000)], "n long, token string").repartition(5)
    side = spark.createDataFrame([("the", 1), ("w2", 2), ("w4", 3)], "token string, id long")
    assert lookup.heavy_values(rows, "token")[0] == "the" and len(lookup.heavy_values(rows, "token")) <= lookup.HEAVY
    want = sorted(map(str, rows.join(side, "token", "left").collect()))
    for heavy in (None, ["the"], ["the", "w2", "absent"], []):
        assert sorted(map(str, lookup.look_up(rows, side, "token", heavy).collect())) == want
    assert lookup.look_up(rows.limit(0), side, "token").count() == 0


def test_one_word_in_half_of_the_positions(spark):
    """No task of the shuffled part has more than twice the median's rows."""
    texts = spark.range(400).select("id", F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(49)), lambda k: F.array(F.lit("the"), F.concat(F.lit("w"), (F.col("id") * 50 + k).cast("string"))))), " ").alias("text"))
    vocab = V.build_vocabulary(texts)
    ids = V.encode_words(texts, vocab, ["id"])
    assert ids.count() == 40_000
    long = ids.select("token_id")
    heavy = lookup.heavy_values(long, "token_id")
    assert max(r["count"] for r in long.where(F.col("token_id").isin(*heavy)).groupBy("token_id").count().collect()) == 20_000
    cold = long.where(~F.col("token_id").isin(*heavy)).repartition(8, "token_id").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    sizes = sorted(r["count"] for r in cold)
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
    back = V.decode_words(ids, vocab, ["id"]).withColumnRenamed("text", "back").join(texts, "id")
    assert back.count() == 400 and back.where("back <> text").count() == 0


def _records(spark):
    """Records that stages have written to shuffles so far."""
    g = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, g.new_array(g.jvm.double, 0), g.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_positions_are_not_shuffled(spark):
    """300 texts of 400 words, of which 997 differ: rows and each shard's different words travel, not 120,000 positions (most of them are of no heavy value)."""
    words = F.transform(F.sequence(F.lit(1), F.lit(400)), lambda k: F.concat(F.lit("w"), ((F.col("id") * 7 + k * k) % 997).cast("string")))
    texts = spark.range(300).select("id", F.array_join(words, " ").alias("text"))
    vocab = V.build_vocabulary(texts).localCheckpoint()
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _records(spark)
        assert V.encode_words(texts, vocab, ["id"]).where("token_id >= 0").agg(F.sum("pos")).first()[0] == 300 * 399 * 200
        assert _records(spark) - before < 30_000
        ids = V.encode_documents(texts, vocab, ["id"])
        back = V.decode_documents(ids, vocab, ["id"]).withColumnRenamed("text", "back").join(texts, "id")
        assert back.count() == 300 and back.where("back <> text").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


def test_arrays_of_odd_rows(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "a b"), (1, "c"), (2, None), (3, ""), (None, "x, y"), (4, "b b zz")], "k long, text string")
    vocab = V.build_vocabulary(texts.where("coalesce(k, 0) <> 4"))
    for size in (lookup.SHARD, 3):
        monkeypatch.setattr(lookup, "SHARD", size)
        ids = V.encode_documents(texts, vocab, ["k"])
        want = [("1", [1, 2]), ("1", [3]), ("2", []), ("3", []), ("4", [2, 2, 6]), ("None", [4, 0, 5])]
        assert sorted((str(r["k"]), list(r["ids"])) for r in ids.collect()) == want
        got = V.decode_documents(ids, vocab, ["k"]).collect()
        assert sorted((str(r["k"]), r["text"]) for r in got) == [("1", "a c b"), ("4", "b b <|UNK|>"), ("None", "x, y")]
        assert V.decode_documents(ids.where("k <> 1"), vocab, ["k"]).collect() == [(4, "b b <|UNK|>")]
    assert V.encode_documents(texts.limit(0), vocab, ["k"]).count() == 0
    with pytest.raises(Exception, match="unknown token id 77"):
        V.decode_documents(spark.createDataFrame([(1, [0, 77])], "k long, ids array<long>"), vocab, ["k"]).collect()
