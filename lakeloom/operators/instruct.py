"""Instruction data: prompts, chat templates, model calls, parsing, judging and comparison."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.functions.text import strip
from lakeloom.sources.shared import drop, keep

from . import prompts as T


def _s(x) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def format_input(instruction="instruction", input_="input") -> Column:
    """The prompt of a sample without its response."""
    given = _s(input_)
    return F.concat(F.lit(T.PREAMBLE + "\n\n### Instruction:\n"), _s(instruction), F.when(given != "", F.concat(F.lit("\n\n### Input:\n"), given)).otherwise(F.lit("")))


def format_sample(instruction="instruction", input_="input", output="output") -> Column:
    return F.concat(format_input(instruction, input_), F.lit("\n\n### Response:\n"), _s(output))


def _fill(template: str, **values: Column) -> Column:
    """A template with {name} places, as a concatenation."""
    parts, rest = [], template
    while rest:
        at = min(((rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest), default=(-1, ""))
        if at[0] < 0:
            parts.append(F.lit(rest))
            break
        if at[0]:
            parts.append(F.lit(rest[: at[0]]))
        parts.append(values[at[1]])
        rest = rest[at[0] + len(at[1]) + 2 :]
    return F.concat(*parts)


def task_prompt(mode: Column, task: Column) -> Column:
    """The prompt that asks for an instruction of a task type (mode A), or for one with an input (mode B)."""
    alone = F.create_map(*[F.lit(x) for kv in T.TASKS_ALONE.items() for x in kv])
    with_input = F.create_map(*[F.lit(x) for kv in T.TASKS_WITH_INPUT.items() for x in kv])
    return F.when(mode == "A", _fill(T.ASK_ALONE, task_description=alone[task])).otherwise(_fill(T.ASK_WITH_INPUT, task_description=with_input[task]))


def response_prompt(instruction="instruction", input_="input") -> Column:
    given = _s(input_)
    return F.concat(_s(instruction), F.lit("\n\n"), F.when(given != "", F.concat(given, F.lit("\n\n"))).otherwise(F.lit("")), F.lit("Answer directly and concisely."))


def sample_block(instruction="instruction", input_="input", output="output") -> Column:
    given = _s(input_)
    middle = F.when(given != "", F.concat(F.lit("\n\n[The Start of Input]\n"), given, F.lit("\n[The End of Input]"))).otherwise(F.lit(""))
    return F.concat(F.lit("[Instruction]\n"), _s(instruction), middle, F.lit("\n\n[The Start of Answer]\n"), _s(output), F.lit("\n[The End of Answer]"))


def reflection_prompt(mode: str, instruction="instruction", input_="input", output="output") -> tuple[Column, Column]:
    """(system, prompt) that asks to reflect on the "response" or the "instruction" of a sample."""
    block = sample_block(instruction, input_, output)
    if mode == "response":
        head = "\n\n".join([T.RESPONSE_TASK, T.RESPONSE_EXAMPLE, "Now do the same for the following:", ""])
        return F.lit(T.RESPONSE_SYSTEM), strip(F.concat(F.lit(head), block))
    if mode == "instruction":
        head = "\n\n".join([T.INSTRUCTION_TASK, T.INSTRUCTION_EXAMPLE, T.INSTRUCTION_RULES, ""])
        return F.lit(T.INSTRUCTION_SYSTEM), strip(F.concat(F.lit(head), block))
    raise ValueError(f"unknown reflection mode: {mode}")


def _tagged(text: Column, tag: str) -> Column:
    """The first [tag] ... [End], stripped; null if there is none."""
    found = F.regexp_extract_all(text, F.lit(rf"(?s)\[{tag}\]\s*(.*?)\s*\[End\]"), F.lit(1))
    return F.when(F.size(found) > 0, strip(F.element_at(found, 1)))


def extract_reflection(text: Column, mode: str = "compat") -> Column:
    """struct(instruction, output), null where a needed tag is missing. "compat" and "instruction" need [New Instruction] and [New Answer];
    "response" needs [Better Answer] and leaves the instruction null."""
    plain = F.regexp_replace(F.regexp_replace(text, F.lit(r"\*{1,2}\["), F.lit("[")), F.lit(r"\]\*{1,2}"), F.lit("]"))
    if mode == "response":
        better = _tagged(plain, "Better Answer")
        return F.when(better.isNotNull(), F.struct(F.lit(None).cast("string").alias("instruction"), better.alias("output")))
    new, answer = _tagged(plain, "New Instruction"), _tagged(plain, "New Answer")
    return F.when(new.isNotNull() & answer.isNotNull(), F.struct(new.alias("instruction"), answer.alias("output")))


def reflected(df: DataFrame, raw: str = "raw", mode: str = "compat") -> DataFrame:
    """df with status ("success" or "failed") and, on success, the new instruction and output; the input stays."""
    got = df.withColumn("_r", extract_reflection(F.col(raw), mode))
    ok = F.col("_r").isNotNull()
    return (
        got.withColumn("status", F.when(ok, "success").otherwise("failed"))
        .withColumn("instruction", F.coalesce("_r.instruction", "instruction"))
        .withColumn("output", F.when(ok, F.col("_r.output")).otherwise(F.col("output")))
        .drop("_r")
    )


def write_routes(df: DataFrame, path: str, mode: str) -> None:
    """Append successes and failures to two JSON-lines folders, from one written table: replies are asked for once, also if an executor is lost."""
    kept = keep(df, "routes")
    kept.where("status = 'success'").drop("status", "raw").write.mode("append").json(f"{path}_{mode}.jsonl")
    kept.where("status = 'failed'").drop("status").write.mode("append").json(f"{path}_{mode}_failed.jsonl")
    drop(kept)


def to_retry(inputs: DataFrame, done: DataFrame, key: str = "pos") -> DataFrame:
    """Inputs that have no success yet."""
    return inputs.join(done.where("status = 'success'").select(key), key, "left_anti")


def judge_prompt() -> Column:
    """From (instruction, input, output, generated_response)."""
    asked = F.concat(
        F.lit("Given the input `"), format_input(), F.lit("` and correct output `"), _s("output"), F.lit("`, score the model response `"), _s("generated_response"), F.lit("` on a scale from 1 to 5.")
    )
    return _fill(T.JUDGE, instruction=asked, reference=_s("output"), answer=_s("generated_response"))


def parse_score(text: Column) -> Column:
    """The first "Score: n"; 0 where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"Score: (\d+)", 1), F.lit("")).try_cast("int"), F.lit(0))


def mean_score(df: DataFrame, *by: str, score: str = "score") -> DataFrame:
    """Rows, rows with a score, and the mean over all rows (missing scores count as 0) to two decimals."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(score) > 0, 1)).alias("n_parsed"), F.round(F.avg(score), 2).alias("mean_score"))


def paired(baseline: DataFrame, other: DataFrame, key: str = "pos", response: str = "generated_response") -> DataFrame:
    """Baseline rows with the other's response, by position; different numbers of rows are an error."""
    n, m = baseline.count(), other.count()
    if n != m:
        raise ValueError(f"{n} rows against {m}")
    return baseline.drop(response).join(other.select(key, response), key)


def compare(scores_a: DataFrame, scores_b: DataFrame, key: str = "pos", score: str = "score") -> DataFrame:
    """One row: both means to two decimals and their difference."""
    both = scores_a.select(key, F.col(score).alias("a")).join(scores_b.select(key, F.col(score).alias("b")), key)
    return both.agg(F.round(F.avg("a"), 2).alias("baseline"), F.round(F.avg("b"), 2).alias("reflection"), F.round(F.avg("b") - F.avg("a"), 2).alias("delta"))


# -- conversations -----------------------------------------------------------------------------


def instruction_rows(conversations: DataFrame) -> DataFrame:
    """(pos, conv_id, turn, instruction, input, output): each user turn that an assistant answers next; the conversation's system
    text is the input."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = conversations.select(
        "conv_id", "turn", "role", F.col("text").alias("instruction"), F.lead("role").over(w).alias("_next"), F.lead("text").over(w).alias("output"), F.first(F.when(F.col("role") == "system", F.col("text")), ignorenulls=True).over(w).alias("_system")
    ).where((F.col("role") == "user") & (F.col("_next") == "assistant"))
    return rows.select("conv_id", "turn", "instruction", _s("_system").alias("input"), "output")


def chat_template(conversations: DataFrame, style: str, prompt_for_reply: bool = True) -> DataFrame:
    """(conv_id, text): whole conversations in the "chatml" or the "llama3" template."""
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    if style == "chatml":
        one = lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["text"], F.lit("<|im_end|>\n"))
        begin, ask = "", "<|im_start|>assistant\n"
    elif style == "llama3":
        one = lambda t: F.concat(F.lit("<|start_header_id|>"), t["role"], F.lit("<|end_header_id|>\n\n"), t["text"], F.lit("<|eot_id|>"))
        begin, ask = "<|begin_of_text|>", "<|start_header_id|>assistant<|end_header_id|>\n\n"
    else:
        raise ValueError(f"unknown chat style: {style}")
    return turns.select("conv_id", F.concat(F.lit(begin), F.array_join(F.transform("t", one), ""), F.lit(ask if prompt_for_reply else "")).alias("text"))


# -- model calls -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Options:
    """Sampling options; None means the provider's default and is left out."""

    temperature: float | None = None
    top_k: int | None = None
    top_p: float | None = None
    num_predict: int | None = None
    num_ctx: int | None = None
    seed: int | None = None

    def to_dict(self) -> dict:
        return {k: v for k, v in asdict(self).items() if v is not None}


def ollama_payload(messages: list[dict], model: str, options: Options | None = None, output_format=None, think: bool | None = None) -> dict:
    out: dict = {"model": model, "messages": messages, "stream": True}
    if think is not None:
        out["think"] = think
    if options is not None and options.to_dict():
        out["options"] = options.to_dict()
    if output_format is not None:
        out["format"] = output_format
    return out


def openai_payload(messages: list[dict], model: str, options: Options | None = None, output_format: dict | None = None) -> dict:
    own = (options or Options()).to_dict()
    out: dict = {"model": model, "input": messages}
    out |= {k: own[k] for k in ("temperature", "top_p") if k in own}
    if "num_predict" in own:
        out["max_output_tokens"] = own["num_predict"]
    if output_format is not None:
        out["text"] = {"format": {"type": "json_schema", "name": "output", "schema": output_format, "strict": True}}
    return out


def read_ndjson(lines: Iterator[str]) -> str:
    """The text of a stream of JSON lines with message.content."""
    return "".join(json.loads(x).get("message", {}).get("content", "") for x in lines if x.strip())


def call_provider(df: DataFrame, key: str, make: Callable[[int], Callable[[str, str], str]], system: str = "system", prompt: str = "prompt", endpoints: int = 1, workers: int = 1) -> DataFrame:
    """df with `raw`: the reply to each prompt. make(i) gives a function (system, prompt) -> text for endpoint i; row k goes to endpoint
    k mod endpoints; errors propagate. There are endpoints * workers tasks at once."""
    schema = df.withColumn("raw", F.lit("")).schema

    def run(batches):
        called = {}
        for pdf in batches:
            which = pdf[key].astype("int64") % endpoints
            for i in which.unique():
                called.setdefault(int(i), make(int(i)))
            yield pdf.assign(raw=pd.Series([called[int(i)](s, p) for i, s, p in zip(which, pdf[system], pdf[prompt], strict=True)], index=pdf.index, dtype=object))

    return df.repartition(endpoints * workers, key).mapInPandas(run, schema)


def assemble_stream(lines: DataFrame, key: str = "key", order: str = "seq", line: str = "line") -> DataFrame:
    """(key, text): the contents of streamed JSON lines in order; unreadable lines add nothing."""
    content = F.coalesce(F.from_json(F.col(line), "message struct<content: string>")["message"]["content"], F.lit(""))
    grouped = lines.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), content.alias("c")))).alias("all"))
    return grouped.select(key, F.array_join(F.transform("all", lambda x: x["c"]), "").alias("text"))


def draw(key: Column, seed: int, which: str) -> Column:
    """A uniform number in [0, 1) from the MD5 of seed, key and a name: the same on any partitioning."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(which)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def planned_tasks(spark, n: int, seed: int) -> DataFrame:
    """(pos, mode, task_type, prompt) of n instructions to generate: modes by weight, task types uniformly."""
    alone, given = F.array(*map(F.lit, T.TASKS_ALONE)), F.array(*map(F.lit, T.TASKS_WITH_INPUT))
    rows = spark.range(n).select(F.col("id").alias("pos"), draw(F.col("id"), seed, "mode").alias("u"), draw(F.col("id"), seed, "task").alias("v"))
    rows = rows.withColumn("mode", F.when(F.col("u") < T.MODE_WEIGHTS["A"], "A").otherwise("B"))
    pick = F.when(F.col("mode") == "A", F.element_at(alone, (F.floor(F.col("v") * len(T.TASKS_ALONE)) + 1).cast("int"))).otherwise(F.element_at(given, (F.floor(F.col("v") * len(T.TASKS_WITH_INPUT)) + 1).cast("int")))
    return rows.select("pos", "mode", pick.alias("task_type")).withColumn("prompt", task_prompt(F.col("mode"), F.col("task_type")))


def generated_samples(spark, n: int, seed: int, make: Callable[[int], Callable[[str, str], str]], endpoints: int = 1) -> DataFrame:
    """(pos, instruction, input, output) of up to n generated samples: a task is planned, the provider asked for an instruction, the reply parsed (empty ones are
    left out, so there may be fewer than n), and the provider asked for the answer. make is that of call_provider()."""
    asked = call_provider(planned_tasks(spark, n, seed).withColumn("system", F.lit("")), "pos", make, endpoints=endpoints)
    parsed = asked.select("pos", parse_task(F.col("raw"), F.col("mode")).alias("task")).where("task IS NOT NULL").select("pos", "task.*")
    answered = call_provider(parsed.withColumn("system", F.lit("")).withColumn("prompt", response_prompt()), "pos", make, endpoints=endpoints)
    return answered.select("pos", "instruction", "input", strip(F.col("raw")).alias("output"))


def with_responses(df: DataFrame, key: str, make: Callable[[int], Callable[[str, str], str]], endpoints: int = 1) -> DataFrame:
    """df with generated_response: the stripped reply of a model to each formatted sample without its output."""
    asked = call_provider(df.withColumn("system", F.lit("")).withColumn("prompt", format_input()), key, make, endpoints=endpoints)
    return asked.withColumn("generated_response", strip(F.col("raw"))).drop("system", "prompt", "raw")


def parse_task(raw: Column, mode: Column) -> Column:
    """struct(instruction, input) of a reply: plain text in mode A, JSON in mode B; unreadable JSON is an error, empty parts give null."""
    parsed = F.from_json(strip(raw), "instruction string, input string", {"mode": "FAILFAST"})
    got = F.when(mode == "A", F.struct(strip(raw).alias("instruction"), F.lit("").alias("input"))).otherwise(F.struct(parsed["instruction"].alias("instruction"), parsed["input"].alias("input")))
    return F.when((got["instruction"] != "") & ((mode == "A") | (got["input"] != "")), got)
