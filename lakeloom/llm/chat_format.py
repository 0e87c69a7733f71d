"""Chat formatting by prefix-target expansion, with DataFrame functions only.

A turn is written ``[INST]role[/INST]text</s>`` and a conversation starts with ``<s>``. Each assistant
turn becomes an example of its own: all turns up to it, with only that reply's text under the loss mask
(``loss_start``, ``loss_length`` in code points; the context is there in full but not trained on). Turns after the last
assistant turn, or a conversation without one, come in one more example with an empty mask, so the
whole conversation can be read back from the output.

Inside roles and texts every control string gets a backslash after its first character (and one more
where backslashes are there already), which unescape() takes out again; after escaping no text holds a control string.

Defined cases: null texts and roles are empty; rows go by turn (nulls first), ties by role, then text;
repeated rows are repeated turns; rows with a null conversation id are one conversation; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = r"(?:/?INST\]|/?s>)"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(rf"([<\[])(\\*{_CONTROL})"), F.lit(r"$1\\$2"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(rf"([<\[])\\(\\*{_CONTROL})"), F.lit("$1$2"))


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, n_examples, formatted, loss_start, loss_length) from rows (conv_id, turn, role, text)."""
    rows = conversations.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    parts = turns.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct((t["role"] == ASSISTANT).alias("target"), F.concat(F.lit(OPEN), escape(t["role"]), F.lit(CLOSE)).alias("head"), escape(t["text"]).alias("body"))).alias("parts"),
    )
    n = F.size("parts")
    ends = F.filter(F.sequence(F.lit(1), n), lambda k: F.element_at("parts", k)["target"] | (k == n))
    one = parts.withColumn("ends", ends).select("conv_id", "parts", F.size("ends").alias("n_examples"), F.posexplode("ends").alias("example", "end"))
    last = F.element_at("parts", F.col("end"))
    before = F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("end") - 1), lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    built = one.select("conv_id", "example", "n_examples", F.concat(F.lit(BEGIN), before, last["head"]).alias("context"), last["body"].alias("reply"), last["target"].alias("target"))
    return built.select(
        "conv_id",
        "example",
        "n_examples",
        F.concat("context", "reply", F.lit(END)).alias("formatted"),
        F.when(F.col("target"), F.length("context")).otherwise(F.lit(0)).alias("loss_start"),
        F.when(F.col("target"), F.length("reply")).otherwise(F.lit(0)).alias("loss_length"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, text)."""
    pieces = F.split(F.substring(formatted, len(BEGIN) + 1, 2147483647), END, -1)
    turns = F.slice(pieces, 1, F.size(pieces) - 1)
    cut = r"(?s)^\[INST\](.*?)\[/INST\](.*)$"
    return F.transform(turns, lambda s: F.struct(unescape(F.regexp_extract(s, cut, 1)).alias("role"), unescape(F.regexp_extract(s, cut, 2)).alias("text")))


def digests(formatted: DataFrame) -> DataFrame:
    """One row for each conversation of examples(), all read from the formatted strings and their masks."""
    last = F.col("example") == F.col("n_examples") - 1
    turns = F.when(last, read_back(F.col("formatted")))
    per_example = formatted.select(
        "conv_id",
        "example",
        F.length("formatted").alias("chars"),
        unescape(F.expr("substring(formatted, loss_start + 1, loss_length)")).alias("loss"),
        turns.alias("turns"),
    ).select(
        "conv_id",
        "chars",
        F.struct("example", "loss").alias("loss"),
        F.size("turns").alias("n"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("sha"),
        F.col("turns").isNotNull().alias("whole"),
    )
    grouped = per_example.groupBy("conv_id").agg(
        F.max(F.when(F.col("whole"), F.col("n"))).alias("n_turns"),
        F.max(F.when(F.col("whole"), F.col("sha"))).alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list("loss")), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return grouped.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars")
    )


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(own).alias("text"))
    return digests(examples(table.unionByName(extra)))
