"""Queries on instruction data, prompts, parsing and scores."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.operators import blocks as B
from lakeloom.operators import instruct as I
from lakeloom.operators import prompts as T
from lakeloom.operators import shuffling
from lakeloom.operators.pairing import pair_files
from lakeloom.operators.reply_store import ReplyStore
from lakeloom.sources.tables import table

from .base import query, scratch


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_ROWS = """rows_ AS (SELECT conv_id, turn, text AS instruction, coalesce(first(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER w, '') AS input, lead(text) OVER w AS output, role, lead(role) OVER w AS next
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    samples AS (SELECT conv_id, turn, instruction, input, output FROM rows_ WHERE role = 'user' AND next = 'assistant')"""
_PROMPT = _q(T.PREAMBLE + "\n\n### Instruction:\n") + " || instruction || CASE WHEN input <> '' THEN " + _q("\n\n### Input:\n") + " || input ELSE '' END"


def _samples(spark, sf_dir):
    return I.instruction_rows(table(spark, sf_dir, "conversations"))


@query("instruction_rows", f"WITH {_ROWS} SELECT * FROM samples")
def instruction_rows(spark, sf_dir):
    return _samples(spark, sf_dir)


@query("instruction_prompts", f"WITH {_ROWS} SELECT conv_id, turn, {_PROMPT} AS prompt, {_PROMPT} || {_q(chr(10) * 2 + '### Response:' + chr(10))} || output AS sample FROM samples")
def instruction_prompts(spark, sf_dir):
    return _samples(spark, sf_dir).select("conv_id", "turn", I.format_input().alias("prompt"), I.format_sample().alias("sample"))


@query("response_prompts", f"WITH {_ROWS} SELECT conv_id, turn, instruction || {_q(chr(10) * 2)} || CASE WHEN input <> '' THEN input || {_q(chr(10) * 2)} ELSE '' END || 'Answer directly and concisely.' AS prompt FROM samples")
def response_prompts(spark, sf_dir):
    return _samples(spark, sf_dir).select("conv_id", "turn", I.response_prompt().alias("prompt"))


_BLOCK = f"""{_q("[Instruction]" + chr(10))} || instruction || CASE WHEN input <> '' THEN {_q(chr(10) * 2 + "[The Start of Input]" + chr(10))} || input || {_q(chr(10) + "[The End of Input]")} ELSE '' END
    || {_q(chr(10) * 2 + "[The Start of Answer]" + chr(10))} || output || {_q(chr(10) + "[The End of Answer]")}"""


@query(
    "reflection_prompts",
    f"""WITH {_ROWS} SELECT conv_id, turn, {_q(T.RESPONSE_SYSTEM)} AS response_system, md5({_q(T.RESPONSE_TASK + chr(10) * 2 + T.RESPONSE_EXAMPLE + chr(10) * 2 + "Now do the same for the following:" + chr(10) * 2)} || {_BLOCK}) AS response_prompt,
    {_q(T.INSTRUCTION_SYSTEM)} AS instruction_system, md5({_q(T.INSTRUCTION_TASK + chr(10) * 2 + T.INSTRUCTION_EXAMPLE + chr(10) * 2 + T.INSTRUCTION_RULES + chr(10) * 2)} || {_BLOCK}) AS instruction_prompt FROM samples""",
)
def reflection_prompts(spark, sf_dir):
    (s1, p1), (s2, p2) = I.reflection_prompt("response"), I.reflection_prompt("instruction")
    return _samples(spark, sf_dir).select("conv_id", "turn", s1.alias("response_system"), F.md5(p1).alias("response_prompt"), s2.alias("instruction_system"), F.md5(p2).alias("instruction_prompt"))


@query(
    "judge_prompts",
    f"""WITH {_ROWS} SELECT conv_id, turn, md5(replace(replace(replace({_q(T.JUDGE)}, '{{reference}}', output), '{{answer}}', instruction), '{{instruction}}',
    'Given the input `' || {_PROMPT} || '` and correct output `' || output || '`, score the model response `' || instruction || '` on a scale from 1 to 5.')) AS prompt FROM samples""",
)
def judge_prompts(spark, sf_dir):
    return _samples(spark, sf_dir).withColumn("generated_response", F.col("instruction")).select("conv_id", "turn", F.md5(I.judge_prompt()).alias("prompt"))


def _draw(seed: int, which: str, key: str = "pos") -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {key} || ':{which}'), 1, 8) AS BIGINT) / 4294967296.0"


def _tasks_sql(n: int, seed: int) -> str:
    """The planned tasks, as `planned` (pos, mode, task_type, prompt)."""
    values = ", ".join(f"({_q(mode)}, {i}, {_q(name)}, {_q(text.replace('{task_description}', about))})" for mode, text, tasks in (("A", T.ASK_ALONE, T.TASKS_ALONE), ("B", T.ASK_WITH_INPUT, T.TASKS_WITH_INPUT)) for i, (name, about) in enumerate(tasks.items()))
    return f"""kinds(mode, i, task_type, prompt) AS (VALUES {values}), sizes AS (SELECT mode, count(*) AS size FROM kinds GROUP BY mode),
    drawn AS (SELECT pos, CASE WHEN {_draw(seed, 'mode')} < 0.7 THEN 'A' ELSE 'B' END AS mode, {_draw(seed, 'task')} AS v FROM (SELECT unnest(generate_series(0, {n - 1})) AS pos)),
    planned AS (SELECT pos, mode, task_type, prompt FROM drawn JOIN sizes USING (mode) JOIN kinds USING (mode) WHERE i = floor(v * size))"""


@query("task_prompts", f"WITH {_tasks_sql(1000, 7)} SELECT * FROM planned")
def task_prompts(spark, sf_dir):
    return I.planned_tasks(spark, 1000, 7)


@query(
    "generation_loop",
    f"""WITH {_tasks_sql(500, 3)}, told AS (SELECT *, length(prompt) AS n FROM planned), task AS (SELECT pos, mode, 'do ' || n AS instruction, CASE WHEN mode = 'B' THEN 'on ' || n ELSE '' END AS input FROM told WHERE mode = 'A' OR n % 5 <> 0)
    SELECT pos, instruction, input, 'answer ' || length(instruction || chr(10) || chr(10) || CASE WHEN input <> '' THEN input || chr(10) || chr(10) ELSE '' END || 'Answer directly and concisely.') AS output FROM task""",
)
def generation_loop(spark, sf_dir):
    """500 tasks through a deterministic provider, whose input is empty for every prompt of a length that five divides in mode B."""
    with_input = T.ASK_WITH_INPUT.partition("{")[0]

    def make(i):
        def reply(system, prompt):
            n = len(prompt)
            if prompt.endswith("Answer directly and concisely."):
                return f" answer {n}\n"
            return f' {{"instruction": "do {n}", "input": "{f"on {n}" if n % 5 else ""}"}} ' if prompt.startswith(with_input) else f"\ndo {n} "

        return reply

    return I.generated_samples(spark, 500, 3, make, 2)


@query("model_responses", f"WITH {_ROWS} SELECT conv_id, turn, instruction, input, output, '<' || length({_PROMPT}) || '>' AS generated_response FROM samples")
def model_responses(spark, sf_dir):
    """A deterministic model stands in: it replies with the prompt's length between blanks."""
    rows = _samples(spark, sf_dir).withColumn("pos", F.col("conv_id") * 1000000 + F.col("turn"))
    return I.with_responses(rows, "pos", lambda i: lambda system, prompt: f"  <{len(prompt)}>\n").drop("pos")


@query("provider_payloads", """SELECT 'ollama' AS provider, '{"model": "m", "messages": [{"role": "user", "content": "hi"}], "stream": true, "think": false, "options": {"temperature": 0.5, "num_predict": 9}, "format": "json"}' AS payload
    UNION ALL SELECT 'openai', '{"model": "m", "input": [{"role": "user", "content": "hi"}], "temperature": 0.5, "max_output_tokens": 9, "text": {"format": {"type": "json_schema", "name": "output", "schema": {"type": "object"}, "strict": true}}}'""")
def provider_payloads(spark, sf_dir):
    """Requests with some options set and the others left out."""
    import json

    said, options = [{"role": "user", "content": "hi"}], I.Options(temperature=0.5, num_predict=9)
    rows = [("ollama", I.ollama_payload(said, "m", options, "json", False)), ("openai", I.openai_payload(said, "m", options, {"type": "object"}))]
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in rows], "provider string, payload string")


@query("task_replies", f"""WITH {_ROWS} SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN trim(instruction, chr(10) || chr(9) || ' ') ELSE instruction END AS instruction, CASE WHEN conv_id % 2 = 0 THEN '' ELSE output END AS input FROM samples
    WHERE CASE WHEN conv_id % 2 = 0 THEN trim(instruction, chr(10) || chr(9) || ' ') <> '' ELSE instruction <> '' AND output <> '' END""")
def task_replies(spark, sf_dir):
    """Replies in both modes, plain text and JSON, parsed back; those with an empty part are left out."""
    rows = _samples(spark, sf_dir).withColumn("mode", F.when(F.col("conv_id") % 2 == 0, "A").otherwise("B"))
    raw = F.when(F.col("mode") == "A", F.concat(F.lit(" \n"), "instruction", F.lit("\n"))).otherwise(F.concat(F.lit("\n"), F.to_json(F.struct("instruction", F.col("output").alias("input"))), F.lit(" ")))
    parsed = rows.select("conv_id", "turn", I.parse_task(raw, F.col("mode")).alias("task"))
    return parsed.where("task IS NOT NULL").select("conv_id", "turn", "task.*")


_RAW = """raw AS (SELECT conv_id, turn, instruction, input, output, CASE (conv_id + turn) % 3
    WHEN 0 THEN 'x **[New Instruction]** ' || instruction || chr(10) || ' [End] y [New Answer] ' || output || ' [End] z' WHEN 1 THEN '[Better Answer]  ' || output || ' [End]' ELSE '[New Instruction] ' || instruction || ' [End]' END AS raw FROM samples)"""


def _raw(spark, sf_dir):
    k = (F.col("conv_id") + F.col("turn")) % 3
    both = F.concat(F.lit("x **[New Instruction]** "), "instruction", F.lit("\n [End] y [New Answer] "), "output", F.lit(" [End] z"))
    text = F.when(k == 0, both).when(k == 1, F.concat(F.lit("[Better Answer]  "), "output", F.lit(" [End]"))).otherwise(F.concat(F.lit("[New Instruction] "), "instruction", F.lit(" [End]")))
    return _samples(spark, sf_dir).withColumn("raw", text)


@query(
    "reflection_extract",
    f"""WITH {_ROWS}, {_RAW} SELECT conv_id, turn, input, CASE WHEN raw LIKE 'x %' THEN 'success' ELSE 'failed' END AS status, CASE WHEN raw LIKE 'x %' THEN regexp_replace(regexp_replace(instruction, '^\\s+', ''), '\\s+$', '') ELSE instruction END AS instruction,
    CASE WHEN raw LIKE 'x %' THEN regexp_replace(regexp_replace(output, '^\\s+', ''), '\\s+$', '') ELSE output END AS output FROM raw""",
)
def reflection_extract(spark, sf_dir):
    return I.reflected(_raw(spark, sf_dir)).select("conv_id", "turn", "input", "status", "instruction", "output")


@query("reflection_extract_response", f"WITH {_ROWS}, {_RAW} SELECT conv_id, turn, CASE WHEN raw LIKE '[Better%' THEN 'success' ELSE 'failed' END AS status FROM raw")
def reflection_extract_response(spark, sf_dir):
    return I.reflected(_raw(spark, sf_dir), mode="response").select("conv_id", "turn", "status")


@query("reflection_retry", f"WITH {_ROWS}, {_RAW} SELECT conv_id, turn FROM raw WHERE raw NOT LIKE 'x %'")
def reflection_retry(spark, sf_dir):
    rows = _raw(spark, sf_dir).withColumn("pos", F.col("conv_id") * 1000000 + F.col("turn"))
    return I.to_retry(rows, I.reflected(rows)).select("conv_id", "turn")


_SCORED = """scored AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 7 = 0 THEN 'no score here' ELSE 'Feedback: fine. Score: ' || ((conv_id * 3 + turn) % 5 + 1) || ' Score: 9' END AS reply,
    'Score: ' || ((conv_id + 2 * turn) % 5 + 1) AS other FROM samples),
    parsed AS (SELECT *, coalesce(CAST(nullif(regexp_extract(reply, 'Score: (\\d+)', 1), '') AS INTEGER), 0) AS score, CAST(regexp_extract(other, 'Score: (\\d+)', 1) AS INTEGER) AS score_b FROM scored)"""


def _replies(spark, sf_dir):
    c, t = F.col("conv_id"), F.col("turn")
    reply = F.when((c + t) % 7 == 0, "no score here").otherwise(F.concat(F.lit("Feedback: fine. Score: "), ((c * 3 + t) % 5 + 1).cast("string"), F.lit(" Score: 9")))
    return _samples(spark, sf_dir).select("conv_id", "turn", reply.alias("reply"), F.concat(F.lit("Score: "), ((c + 2 * t) % 5 + 1).cast("string")).alias("other"))


@query("score_parse", f"WITH {_ROWS}, {_SCORED} SELECT conv_id, turn, score FROM parsed")
def score_parse(spark, sf_dir):
    return _replies(spark, sf_dir).select("conv_id", "turn", I.parse_score(F.col("reply")).alias("score"))


@query("score_mean", f"WITH {_ROWS}, {_SCORED} SELECT count(*) AS n, count(CASE WHEN score > 0 THEN 1 END) AS n_parsed, round(avg(score), 2) AS mean_score FROM parsed")
def score_mean(spark, sf_dir):
    return I.mean_score(_replies(spark, sf_dir).select(I.parse_score(F.col("reply")).alias("score")))


@query("score_compare", f"WITH {_ROWS}, {_SCORED} SELECT round(avg(score), 2) AS baseline, round(avg(score_b), 2) AS reflection, round(avg(score_b) - avg(score), 2) AS delta FROM parsed")
def score_compare(spark, sf_dir):
    rows = _replies(spark, sf_dir).withColumn("pos", F.col("conv_id") * 1000000 + F.col("turn"))
    return I.compare(rows.select("pos", I.parse_score(F.col("reply")).alias("score")), rows.select("pos", I.parse_score(F.col("other")).alias("score")))


_NUMBERED = "numbered AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos, count(*) OVER () AS n FROM samples)"


def _numbered(spark, sf_dir):
    """Samples with their position in order (conv_id, turn): conversations' sizes are summed up first."""
    from lakeloom.operators.ranking import prefix_sum

    rows = _samples(spark, sf_dir)
    sizes = prefix_sum(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("k")), "conv_id", "k", "before").select("conv_id", "before")
    return rows.withColumn("at", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1).join(sizes, "conv_id").withColumn("pos", F.col("before") + F.col("at")).drop("before", "at")


@query("instruction_split", f"WITH {_ROWS}, {_NUMBERED} SELECT conv_id, turn, pos, CASE WHEN pos < floor(n * 0.85) THEN 'train' WHEN pos < floor(n * 0.85) + floor(n * 0.1) THEN 'test' ELSE 'val' END AS split FROM numbered")
def instruction_split(spark, sf_dir):
    rows = _numbered(spark, sf_dir)
    return B.fraction_split(rows, "pos", rows.count()).select("conv_id", "turn", "pos", "split")


@query(
    "collate",
    f"""WITH {_ROWS}, {_NUMBERED}, t AS (SELECT pos, pos // 8 AS batch, list_transform(generate_series(1, CAST(length(instruction) AS BIGINT)), lambda i: ascii(instruction[i]))[1:1023] AS s FROM numbered),
    l AS (SELECT *, least(max(len(s) + 1) OVER (PARTITION BY batch), 1024) AS size FROM t),
    f AS (SELECT pos, size, list_concat(s, list_transform(generate_series(1, CAST(size - len(s) AS BIGINT)), lambda i: 101)) AS full_ FROM l),
    g AS (SELECT pos, size, full_[1:size - 1] AS inputs, full_[2:size] AS targets FROM f)
    SELECT pos, CAST(size - 1 AS INTEGER) AS n, CAST(list_sum(list_transform(inputs, lambda x, i: x * i)) AS BIGINT) AS input_sum,
        CAST(list_sum(list_transform(targets, lambda x, i: CASE WHEN x = 101 AND i > list_position(targets, 101) THEN -100 ELSE x END * i)) AS BIGINT) AS target_sum FROM g""",
)
def collate(spark, sf_dir):
    """Whole instructions, up to the model's context of 1,024, which is the operator's feature; collate_samples takes whole samples without one."""
    chars = F.transform(F.filter(F.split("instruction", F.lit(""), F.lit(-1)), lambda c: c != ""), F.ascii)
    rows = _numbered(spark, sf_dir).select("pos", F.floor(F.col("pos") / 8).alias("batch"), chars.alias("ids"))
    return _sums(B.collate(rows, "batch", "ids", pad=101))


def _sums(got):
    weighted = lambda c: F.aggregate(F.transform(c, lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return got.select("pos", F.size("inputs").alias("n"), weighted("inputs").alias("input_sum"), weighted("targets").alias("target_sum"))


@query(
    "collate_samples",
    f"""WITH {_ROWS}, {_NUMBERED}, w AS (SELECT pos, {_PROMPT} || {_q(chr(10) * 2 + '### Response:' + chr(10))} || output AS sample FROM numbered),
    t AS (SELECT pos, pos // 8 AS batch, list_transform(generate_series(1, CAST(length(sample) AS BIGINT)), lambda i: ascii(sample[i])) AS s FROM w),
    l AS (SELECT *, max(len(s) + 1) OVER (PARTITION BY batch) AS size FROM t),
    f AS (SELECT pos, size, list_concat(s, list_transform(generate_series(1, CAST(size - len(s) AS BIGINT)), lambda i: 50256)) AS full_ FROM l),
    g AS (SELECT pos, size, full_[1:size - 1] AS inputs, full_[2:size] AS targets FROM f)
    SELECT pos, CAST(size - 1 AS INTEGER) AS n, CAST(list_sum(list_transform(inputs, lambda x, i: x * i)) AS BIGINT) AS input_sum,
        CAST(list_sum(list_transform(targets, lambda x, i: CASE WHEN x = 50256 AND i > list_position(targets, 50256) THEN -100 ELSE x END * i)) AS BIGINT) AS target_sum FROM g""",
)
def collate_samples(spark, sf_dir):
    """All characters of the formatted samples, instruction, input and response; nothing is cut."""
    rows = _numbered(spark, sf_dir).withColumn("sample", I.format_sample())
    chars = F.transform(F.filter(F.split("sample", F.lit(""), F.lit(-1)), lambda c: c != ""), F.ascii)
    return _sums(B.collate(rows.select("pos", F.floor(F.col("pos") / 8).alias("batch"), chars.alias("ids")), "batch", "ids", longest=None))


@query("sample_batches", f"WITH {_ROWS}, {_NUMBERED} SELECT conv_id, turn, CAST(pos // 8 AS BIGINT) AS batch_id, CAST(pos % 8 AS INTEGER) AS row FROM numbered WHERE pos // 8 < n // 8")
def sample_batches(spark, sf_dir):
    rows = _numbered(spark, sf_dir)
    return B.sample_batches(rows, "pos", 8, rows.count(), drop_last=True).select("conv_id", "turn", "batch_id", "row")


def _shuffled_sql(n: str, seed: int) -> str:
    """SQL: the place of `pos` in the seeded order of n (a column) rows, rounds and all."""
    a, b = "CAST(ceil(sqrt(n)) AS BIGINT)", "((n + CAST(ceil(sqrt(n)) AS BIGINT) - 1) // CAST(ceil(sqrt(n)) AS BIGINT))"
    x = "[v % a, v // a]"
    for k, (c, d, e) in enumerate(shuffling.keys(seed)):
        mixed = f"(s[{1 if k % 2 else 2}] * {c} + {d}) % 2147483647 * {e} % 2147483629"
        new = f"[s[1], (s[2] + {mixed}) % b]" if k % 2 else f"[(s[1] + {mixed}) % a, s[2]]"
        x = f"list_transform([{x}], lambda s: {new})[1]"
    cell = f"list_transform([{x}], lambda s: s[1] + s[2] * a)[1]"
    return f"(SELECT *, list_reduce(list_concat([CAST(pos AS BIGINT), 0], range(1, 41)), lambda v, i: CASE WHEN i = 0 OR v >= n THEN {cell} ELSE v END) AS place FROM (SELECT *, {a} AS a, {b} AS b FROM {n}))"


@query("shuffled_batches", f"WITH {_ROWS}, {_NUMBERED}, placed AS {_shuffled_sql('numbered', 7)} SELECT conv_id, turn, CAST(place // 8 AS BIGINT) AS batch_id, CAST(place % 8 AS INTEGER) AS row FROM placed WHERE place // 8 < n // 8")
def shuffled_batches(spark, sf_dir):
    """Batches in a seeded order, the incomplete last one dropped."""
    rows = _numbered(spark, sf_dir)
    return B.sample_batches(rows, "pos", 8, rows.count(), drop_last=True, seed=7).select("conv_id", "turn", "batch_id", "row")


@query("response_pairs", f"WITH {_ROWS}, {_NUMBERED} SELECT pos, instruction, length(output) AS n_baseline, length(instruction) AS n_other FROM numbered")
def response_pairs(spark, sf_dir):
    """Two files of responses, of which one lacks keys, paired row by row."""
    folder = scratch(spark, "pairs")
    rows = _samples(spark, sf_dir).orderBy("conv_id", "turn")
    rows.select("instruction", F.col("output").alias("generated_response")).write.parquet(f"{folder}/a")
    rows.select(F.lit("").alias("instruction"), F.col("instruction").alias("generated_response")).write.parquet(f"{folder}/b")
    got = pair_files(spark, f"{folder}/a", f"{folder}/b")
    return got.select("pos", "instruction", F.length("generated_response").cast("long").alias("n_baseline"), F.length("generated_response_other").cast("long").alias("n_other"))


@query(
    "stored_replies",
    f"WITH {_ROWS}, p AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'one question' ELSE instruction END AS prompt FROM samples), n AS (SELECT count(DISTINCT prompt) AS n_asked FROM p) SELECT conv_id, turn, 'about ' || length(prompt) AS raw, n_asked FROM p, n",
)
def stored_replies(spark, sf_dir):
    """Replies through a store in two goes: the first one asks for half of the conversations, the second only for what is not stored; a third of the prompts are one."""
    prompt = F.when(F.col("conv_id") % 3 == 0, "one question").otherwise(F.col("instruction"))
    rows = _samples(spark, sf_dir).select("conv_id", "turn", F.lit("").alias("system"), prompt.alias("prompt"))
    store = ReplyStore(spark, scratch(spark, "replies"), "a model", I.Options(seed=1))
    make = lambda i: lambda system, prompt: f"about {len(prompt)}"
    asked = store.fill(rows.where("conv_id % 2 = 0"), make) + store.fill(rows, make) + store.fill(rows, make)
    return store.answered(rows).select("conv_id", "turn", "raw", F.lit(asked).cast("long").alias("n_asked"))


@query("chat_chatml", "SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS text FROM conversations GROUP BY conv_id")
def chat_chatml(spark, sf_dir):
    return I.chat_template(table(spark, sf_dir, "conversations"), "chatml")


@query(
    "chat_llama3",
    "SELECT conv_id, '<|begin_of_text|>' || string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || text || '<|eot_id|>', '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
)
def chat_llama3(spark, sf_dir):
    return I.chat_template(table(spark, sf_dir, "conversations"), "llama3", prompt_for_reply=False)


@query("provider_calls", f"WITH {_ROWS}, {_NUMBERED} SELECT pos, CAST(pos % 3 AS BIGINT) || ':' || length(instruction) AS raw FROM numbered")
def provider_calls(spark, sf_dir):
    """A deterministic provider stands in for a model."""

    def make(i):
        return lambda system, prompt: f"{i}:{len(prompt)}"

    rows = _numbered(spark, sf_dir).select("pos", F.lit("").alias("system"), F.col("instruction").alias("prompt"))
    return I.call_provider(rows, "pos", make, endpoints=3).select("pos", "raw")


@query("stream_assembly", "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def stream_assembly(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("line"))
    return I.assemble_stream(rows, "conv_id", "turn")
