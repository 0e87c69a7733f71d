"""Reply store, reply streams, seeded order and pairing: recovery, skew and odd rows."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import blocks as B
from lakeloom.operators import pairing, shuffling
from lakeloom.operators.instruct import Options, reflected
from lakeloom.operators.reply_store import ProviderError, ReplyStore
from lakeloom.streaming import replies as R

PROMPTS = "n long, system string, prompt string, key string, raw0 string"


def asked(folder):
    return sorted(open(f"{folder}/{f}").read() for f in os.listdir(folder))


def counting(folder, broken=""):
    """A provider that notes each prompt it is asked in a file of its own."""

    def make(i):
        def ask(system, prompt):
            if broken and broken in prompt:
                raise ValueError("no")
            import uuid

            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(prompt)
            return f"<{system}|{prompt}>"

        return ask

    return make


def test_store_asks_once(spark, tmp_path):
    heard = tmp_path / "heard"
    heard.mkdir()
    rows = [(i, "s" if i % 2 else None, f"p{i % 7}", "k", None) for i in range(60)] + [(60, "s", None, "k", None), (61, None, "bad", "k", None), (61, None, "bad", "k", None)]
    df = spark.createDataFrame(rows, PROMPTS).repartition(3)
    store = ReplyStore(spark, f"{tmp_path}/store", "m", Options(seed=3))
    assert store.answered(df).where("raw IS NOT NULL").count() == 0
    with pytest.raises(ProviderError):
        store.fill(df, counting(heard, "bad"), batch=4)
    first = asked(heard)
    with pytest.raises(ProviderError):
        store.fill(df, counting(heard, "bad"), batch=100)
    assert store.fill(df, counting(heard), endpoints=2, batch=3) == 1  # only what failed
    assert store.fill(df, counting(heard)) == 0
    assert len(asked(heard)) == 16 and set(first) <= set(asked(heard))
    got = {(r["system"], r["prompt"]): r["raw"] for r in store.answered(df).collect()}
    assert got == {(s, p): f"<{s or ''}|{p or ''}>" for _, s, p, _, _ in rows} and store.answered(df).count() == len(rows)
    other = ReplyStore(spark, f"{tmp_path}/store", "m", Options(seed=4))
    assert other.answered(df).where("raw IS NOT NULL").count() == 0
    assert store.fill(df.limit(0), counting(heard)) == 0


def test_keys_do_not_run_together(spark, tmp_path):
    df = spark.createDataFrame([(1, "ab", "c", "", ""), (2, "a", "bc", "", ""), (3, "", "abc", "", "")], PROMPTS)
    store = ReplyStore(spark, f"{tmp_path}/store", "m")
    assert df.select(store.key("system", "prompt").alias("x")).distinct().count() == 3


def write_lines(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.writelines((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines)


def line(key, seq, content, done=False):
    return {"key": key, "seq": seq, "done": done, "message": {"content": content}}


def routed(batch):
    return reflected(batch.select("key", "raw", F.lit("").alias("instruction"), F.lit("").alias("input"), F.col("raw").alias("output"))).select("key", "output", "status")


def test_stream_stops_and_goes_on(spark, tmp_path):
    src, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    write_lines(src, "a.json", [line("one", 0, "[New Instruction] i [End]"), line("two", 1, "b", True), "no json", {"seq": 3}, line("late", 0, "x")])
    write_lines(src, "b.json", [line("one", 1, "[New Answer] "), line("one", 1, "[New Answer] "), line("two", 0, "a")])
    write_lines(src, "c.json", [line("one", 2, "yes [End]", True), line("late", 2, None, True)])

    def stops(batch):
        got = routed(batch)
        if got.where("key = 'one'").count():
            raise RuntimeError("stopped in the middle of a batch")
        return got

    query = R.write_routes(R.assembled(R.read_lines(spark, src, 1)), stops, out, state)
    with pytest.raises(Exception, match="stopped in the middle"):
        query.awaitTermination()
    write_lines(src, "d.json", [line("late", 1, "y"), line("one", 2, "yes [End]", True)])
    R.write_routes(R.assembled(R.read_lines(spark, src, 1)), routed, out, state).awaitTermination()
    read = lambda kind: sorted((r["key"], r["output"]) for r in spark.read.schema("key string, output string").json(f"{out}/{kind}").collect())
    assert read("success") == [("one", "yes")] and read("failed") == [("late", "xy"), ("two", "ab")]
    R.write_routes(R.assembled(R.read_lines(spark, src, 1)), routed, out, state).awaitTermination()
    assert read("success") == [("one", "yes")] and len(read("failed")) == 2


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 17, 100, 1000, 1023])
def test_seeded_order_is_an_order(spark, n):
    for seed in (0, 7):
        got = [r["p"] for r in spark.range(n).select(shuffling.shuffled_place(F.col("id"), n, seed).alias("p")).collect()]
        assert sorted(got) == list(range(n))
        assert n < 17 or got != list(range(n))


def test_seeded_order_of_very_many(spark):
    n = 10**15 + 37
    some = spark.range(0, n, n // 5000)
    got = some.select(shuffling.shuffled_place(F.col("id"), n, 1).alias("p"))
    r = got.agg(F.min("p").alias("a"), F.max("p").alias("b"), F.count_distinct("p").alias("k"), F.avg("p").alias("m")).first()
    assert 0 <= r["a"] and r["b"] < n and r["k"] == some.count() and abs(r["m"] / n - 0.5) < 0.03


def test_shuffled_batches_drop_the_last(spark):
    df = spark.range(21).withColumnRenamed("id", "pos")
    got = B.sample_batches(df, "pos", 4, 21, drop_last=True, seed=5).collect()
    assert len(got) == 20 and sorted((r["batch_id"], r["row"]) for r in got) == [(i // 4, i % 4) for i in range(20)]


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_pairs_by_place(spark, tmp_path, kind):
    rows = spark.createDataFrame([(i, f"r{i}" * (1 + i % 50), "_") for i in range(3000)], "i long, generated_response string, _order string").orderBy("i")
    rows.repartitionByRange(5, "i").sortWithinPartitions("i").write.format(kind).save(f"{tmp_path}/a")
    rows.repartitionByRange(3, "i").sortWithinPartitions("i").withColumn("generated_response", F.concat(F.lit("o"), "generated_response")).write.format(kind).save(f"{tmp_path}/b")
    schema = "i long, generated_response string"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = pairing.pair_files(spark, f"{tmp_path}/a", f"{tmp_path}/b", kind, schema=schema)
        assert got.where("pos <> i OR generated_response_other <> concat('o', generated_response)").count() == 0 and got.count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows.limit(10).write.format(kind).save(f"{tmp_path}/c")
    with pytest.raises(ValueError, match="3000 rows against 10"):
        pairing.pair_files(spark, f"{tmp_path}/a", f"{tmp_path}/c", kind, schema=schema)
