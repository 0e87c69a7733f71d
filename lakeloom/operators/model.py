"""Model mathematics on tables: embeddings, attention, blocks, losses and weight tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.errors import EmbeddingsError
from lakeloom.functions import vectors as V

from .attention import attention  # noqa: F401  part of this module's interface

# Sizes of the published GPT-2 models.
GPT2_SIZES = {
    "124M": {"vocab_size": 50257, "context_length": 1024, "num_layers": 12, "num_heads": 12, "embed_dim": 768, "hidden_dim": 3072},
    "355M": {"vocab_size": 50257, "context_length": 1024, "num_layers": 24, "num_heads": 16, "embed_dim": 1024, "hidden_dim": 4096},
    "774M": {"vocab_size": 50257, "context_length": 1024, "num_layers": 36, "num_heads": 20, "embed_dim": 1280, "hidden_dim": 5120},
    "1558M": {"vocab_size": 50257, "context_length": 1024, "num_layers": 48, "num_heads": 25, "embed_dim": 1600, "hidden_dim": 6400},
}


def embed(tokens: DataFrame, token_table: DataFrame, position_table: DataFrame, keys: list[str], context_length: int) -> DataFrame:
    """(keys, pos, x): token vector plus position vector; tables are (token_id, vector) and (pos, vector)."""
    longest = tokens.agg(F.max("pos")).first()[0]
    if longest is not None and longest >= context_length:
        raise EmbeddingsError(f"position {longest} is outside the context of {context_length}")
    t = token_table.select("token_id", F.col("vector").alias("_t"))
    p = position_table.select("pos", F.col("vector").alias("_p"))
    return tokens.join(t, "token_id").join(p, "pos").select(*keys, "pos", V.add(F.col("_t"), F.col("_p")).alias("x"))


def cross_entropy(logits: DataFrame, logit: str = "logits", target: str = "target", ignore: int = -100) -> DataFrame:
    """One row: the mean of -ln softmax[target] over targets that are not ignored."""
    log_sum = V.let(F.array_max(logit), lambda m: m + F.log(V.total(F.transform(F.col(logit), lambda x: F.exp(x - m)))))
    loss = log_sum - F.element_at(logit, F.col(target) + 1)
    return logits.where(F.col(target) != ignore).agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("n"))


def parameter_count(weights: DataFrame, data: str = "data") -> DataFrame:
    """One row: millions of parameters of a weights table."""
    return weights.agg((F.sum(F.size(data)) / 1e6).alias("millions"))


def gpt2_parameters(size: str) -> float:
    """Millions of parameters of a GPT-2 model with a tied output head."""
    c = GPT2_SIZES[size]
    d, h = c["embed_dim"], c["hidden_dim"]
    block = 4 * d + 3 * (d * d + d) + d * d + d + d * h + h + h * d + d
    return (c["vocab_size"] * d + c["context_length"] * d + c["num_layers"] * block + 2 * d) / 1e6


def remap_weights(weights: DataFrame) -> DataFrame:
    """(name, shape, data) of a published GPT-2 checkpoint under this library's names: block matrices transposed, the fused query, key
    and value split in three."""
    rename = [(r"^wte\.weight$", "tok_emb.weight"), (r"^wpe\.weight$", "pos_emb.weight"), (r"^ln_f\.weight$", "ln_f.scale"), (r"^ln_f\.bias$", "ln_f.shift")]
    rename += [(r"^h\.(\d+)\.ln_([12])\.weight$", "blocks.$1.ln$2.scale"), (r"^h\.(\d+)\.ln_([12])\.bias$", "blocks.$1.ln$2.shift")]
    rename += [(r"^h\.(\d+)\.attn\.c_proj\.", "blocks.$1.attn.out_proj."), (r"^h\.(\d+)\.mlp\.c_fc\.", "blocks.$1.mlp.fc1."), (r"^h\.(\d+)\.mlp\.c_proj\.", "blocks.$1.mlp.fc2.")]
    kept = weights.where(F.col("name").rlike(r"^(wte|wpe|ln_f|h\.\d+\.(ln_[12]|attn\.c_attn|attn\.c_proj|mlp\.c_fc|mlp\.c_proj))\.(weight|bias)$"))
    matrix = F.col("name").rlike(r"\.(c_attn|c_proj|c_fc)\.weight$")
    fused = F.col("name").contains(".c_attn.")
    name = F.col("name")
    for a, b in rename:
        name = F.regexp_replace(name, a, b)
    rows = kept.select("*", matrix.alias("matrix"), fused.alias("fused"), name.alias("new"))
    parts = rows.withColumn("part", F.explode(F.when(F.col("fused"), F.array(*map(F.lit, "qkv"))).otherwise(F.array(F.lit("")))))
    own = F.when(F.col("fused"), F.regexp_replace(F.concat(F.col("name"), F.lit("|"), F.col("part")), r"^h\.(\d+)\.attn\.c_attn\.(\w+)\|(\w)$", r"blocks.$1.attn.$3_proj.$2")).otherwise(F.col("new"))
    rows_n, cols_n = F.element_at("shape", 1), F.element_at("shape", -1)
    width = F.when(F.col("fused"), (cols_n / 3).cast("int")).otherwise(cols_n)
    first = F.when(F.col("part") == "k", width).when(F.col("part") == "v", width * 2).otherwise(F.lit(0))
    # output (i, j) of a transposed matrix is input (j, first + i)
    transposed = F.transform(F.sequence(F.lit(0), width * rows_n - 1), lambda x: F.element_at(F.col("data"), ((x % rows_n) * cols_n + first + F.floor(x / rows_n) + 1).cast("int")))
    vector = F.when(F.col("fused"), F.slice("data", first + 1, width)).otherwise(F.col("data"))
    shape = F.when(F.col("matrix"), F.array(width, rows_n)).when(F.col("fused"), F.array(width)).otherwise(F.col("shape"))
    # other names at first: inside lambdas, a column would resolve to an output of the same name
    return parts.select(own.alias("_name"), shape.alias("_shape"), F.when(F.col("matrix"), transposed).otherwise(vector).alias("_data")).toDF("name", "shape", "data")


class Gpt2:
    """A NumPy forward pass from a dict of weights, for Arrow batches."""

    def __init__(self, weights: dict[str, np.ndarray], num_heads: int):
        self.w, self.heads = {k: np.asarray(v, np.float64) for k, v in weights.items()}, num_heads
        self.layers = sum(1 for k in weights if k.endswith(".ln1.scale"))

    def _norm(self, x, name):
        m = x - x.mean(-1, keepdims=True)
        return m / np.sqrt((m * m).mean(-1, keepdims=True) + 1e-5) * self.w[f"{name}.scale"] + self.w[f"{name}.shift"]

    def _linear(self, x, name):
        return x @ self.w[f"{name}.weight"].T + self.w.get(f"{name}.bias", 0.0)

    def logits(self, ids: list[int]) -> np.ndarray:
        from math import erf, sqrt

        n = len(ids)
        if n > len(self.w["pos_emb.weight"]):
            raise EmbeddingsError("the sequence is longer than the context")
        x = self.w["tok_emb.weight"][ids] + self.w["pos_emb.weight"][:n]
        mask = np.triu(np.full((n, n), -np.inf), 1)
        for i in range(self.layers):
            b = f"blocks.{i}"
            h = self._norm(x, f"{b}.ln1")
            q, k, v = (self._linear(h, f"{b}.attn.{p}_proj").reshape(n, self.heads, -1).transpose(1, 0, 2) for p in "qkv")
            s = q @ k.transpose(0, 2, 1) / np.sqrt(q.shape[-1]) + mask
            s = np.exp(s - s.max(-1, keepdims=True))
            x = x + self._linear(((s / s.sum(-1, keepdims=True)) @ v).transpose(1, 0, 2).reshape(n, -1), f"{b}.attn.out_proj")
            h = self._linear(self._norm(x, f"{b}.ln2"), f"{b}.mlp.fc1")
            x = x + self._linear(0.5 * h * (1 + np.vectorize(erf)(h / sqrt(2))), f"{b}.mlp.fc2")
        return self._norm(x, "ln_f") @ self.w["tok_emb.weight"].T


def generate_ids(next_logits, prompt: list[int], new_tokens: int, context_length: int, eos: int | None = None, choose=None):
    """Ids one by one: the context is the last context_length ids; stops after eos."""
    ids = list(prompt)
    for _ in range(new_tokens):
        logits = next_logits(ids[-context_length:])
        ids.append(int(np.argmax(logits)) if choose is None else int(choose(logits)))
        yield ids[-1]
        if eos is not None and ids[-1] == eos:
            return


def context_length(model, fallback: int = 1024) -> int:
    """The context that a model was made for: its own attribute, that of its configuration (an object or a dict), or the fallback."""
    own = getattr(model, "context_length", None)
    config = getattr(model, "config", None)
    if own is None and config is not None:
        own = config.get("context_length") if isinstance(config, dict) else getattr(config, "context_length", None)
    return int(own) if own else fallback


def token_steps(prompts: DataFrame, key: str, make_model, new_tokens: int, context_length: int, ids: str = "token_ids", eos: int | None = None, choose=None) -> DataFrame:
    """(key, step, token_id): a row for each new token, in the order in which they are made, eos included."""

    def run(batches):
        model = make_model()
        for b in batches:
            for k, p in zip(b.column(key), b.column(ids).to_pylist(), strict=True):
                got = list(generate_ids(model, p, new_tokens, context_length, eos, choose))
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(got), b.column(key).type), pa.array(range(len(got)), pa.int32()), pa.array(got, pa.int64())], names=[key, "step", "token_id"])

    kind = dict(prompts.dtypes)[key]
    return prompts.select(key, ids).mapInArrow(run, f"`{key}` {kind}, step int, token_id long")


def generate_and_decode(prompts: DataFrame, key: str, bpe, make_model, new_tokens: int, context_length: int, text: str = "text", eos: int | None = None, choose=None) -> DataFrame:
    """(key, generated_text): prompts encoded, continued, and the new ids up to eos decoded."""
    from .bpe import decode, encode_cached

    coded = prompts.select(key, encode_cached(F.col(text), bpe).alias("token_ids"))
    made = generate(coded, key, make_model, new_tokens, context_length, "token_ids", eos, choose)
    return made.select(key, decode(F.transform("generated", lambda x: x.cast("int")), bpe).alias("generated_text"))


def generate(prompts: DataFrame, key: str, make_model, new_tokens: int, context_length: int, ids: str = "token_ids", eos: int | None = None, choose=None) -> DataFrame:
    """(key, generated): new ids for each prompt without the prompt, up to and without eos; make_model() runs once in a worker."""

    def run(batches):
        model = make_model()
        for b in batches:
            out = []
            for p in b.column(ids).to_pylist():
                got = list(generate_ids(model, p, new_tokens, context_length, eos, choose))
                out.append(got[: got.index(eos)] if eos in got else got)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(out, pa.list_(pa.int64()))], names=[key, "generated"])

    kind = dict(prompts.dtypes)[key]
    return prompts.select(key, ids).mapInArrow(run, f"`{key}` {kind}, generated array<long>")
