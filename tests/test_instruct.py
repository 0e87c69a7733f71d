import pytest
from pyspark.sql import functions as F

from lakeloom.operators import instruct as I


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr.alias("x")).first()["x"]


def test_prompts(spark):
    base = "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n### Instruction:\nDo it"
    assert one(spark, I.format_input(), instruction="Do it", input="") == base
    assert one(spark, I.format_sample(), instruction="Do it", input="x", output="y") == base + "\n\n### Input:\nx\n\n### Response:\ny"
    assert one(spark, I.response_prompt(), instruction="Do", input="") == "Do\n\nAnswer directly and concisely."
    assert one(spark, I.response_prompt(), instruction="Do", input="z") == "Do\n\nz\n\nAnswer directly and concisely."
    assert "type: grammar or spelling correction of a sentence.\n" in one(spark, I.task_prompt(F.col("m"), F.col("t")), m="B", t="grammar_correction")
    with pytest.raises(ValueError):
        I.reflection_prompt("other")
    system, prompt = I.reflection_prompt("response")
    assert one(spark, prompt, instruction="i", input="", output="o").endswith("[Instruction]\ni\n\n[The Start of Answer]\no\n[The End of Answer]")


def test_extraction(spark):
    good = "a **[New Instruction]** one\ntwo [End] [New Answer]  x [End] [New Answer] later [End]"
    got = one(spark, I.extract_reflection(F.col("t")), t=good)
    assert (got["instruction"], got["output"]) == ("one\ntwo", "x")
    assert one(spark, I.extract_reflection(F.col("t")), t="[Better Answer] x [End]") is None
    assert one(spark, I.extract_reflection(F.col("t"), "response"), t="[Better Answer] x [End]")["output"] == "x"
    assert one(spark, I.extract_reflection(F.col("t")), t="[New Instruction] only [End]") is None


def test_scores(spark):
    assert [one(spark, I.parse_score(F.col("t")), t=t) for t in ("Score: 4", "x Score: 12 Score: 3", "none", "Score: x")] == [4, 12, 0, 0]
    df = spark.createDataFrame([(4,), (0,), (5,)], "score int")
    row = I.mean_score(df).first()
    assert (row["n"], row["n_parsed"], row["mean_score"]) == (3, 2, 3.0)
    with pytest.raises(ValueError):
        I.paired(spark.range(2).withColumnRenamed("id", "pos"), spark.range(3).withColumnRenamed("id", "pos"))


def test_payloads_and_stream(spark):
    o = I.Options(temperature=0.5, num_predict=10, top_k=3)
    assert I.ollama_payload([], "m", o, think=False) == {"model": "m", "messages": [], "stream": True, "think": False, "options": {"temperature": 0.5, "num_predict": 10, "top_k": 3}}
    got = I.openai_payload([], "m", o, {"type": "object"})
    assert got["max_output_tokens"] == 10 and "top_k" not in got and got["text"]["format"]["strict"]
    assert I.read_ndjson(['{"message":{"content":"a"}}', "", '{"message":{"content":"b"}}']) == "ab"


def test_routes_and_retry(spark, tmp_path):
    rows = spark.createDataFrame([(0, "i", "in", "o", "[New Instruction] n [End][New Answer] a [End]"), (1, "i", "in", "o", "bad")], "pos long, instruction string, input string, output string, raw string")
    done = I.reflected(rows)
    I.write_routes(done, str(tmp_path / "out"), "instruction")
    ok = spark.read.json(str(tmp_path / "out_instruction.jsonl")).first()
    assert (ok["instruction"], ok["input"], ok["output"]) == ("n", "in", "a")
    assert spark.read.json(str(tmp_path / "out_instruction_failed.jsonl")).count() == 1
    assert [r["pos"] for r in I.to_retry(rows, done).collect()] == [1]


def test_parse_task(spark):
    assert one(spark, I.parse_task(F.col("t"), F.lit("A")), t=" ask ")["instruction"] == "ask"
    got = one(spark, I.parse_task(F.col("t"), F.lit("B")), t='{"instruction": "i", "input": "x"}')
    assert (got["instruction"], got["input"]) == ("i", "x")
    assert one(spark, I.parse_task(F.col("t"), F.lit("B")), t='{"instruction": "i", "input": ""}') is None
