"""Queries on sampling, model mathematics and training control."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lakeloom.functions import vectors as V
from lakeloom.operators import experts as E
from lakeloom.operators import model as M
from lakeloom.operators import tiles
from lakeloom.operators import training as R
from lakeloom.operators.bpe import Bpe
from lakeloom.operators.instruct import draw
from lakeloom.operators.ranking import prefix_sum
from lakeloom.sources.tables import table

from .base import query


def _logits(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("x"))


_L = "l AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings)"
_SOFT = "list_transform({x}, lambda v: exp(v - list_max({x})) / list_sum(list_transform({x}, lambda u: exp(u - list_max({x})))))"


def _long(df, column, name, digits=6):
    return df.select("vec_id", F.posexplode(column).alias("idx", "_v")).select("vec_id", "idx", (F.round("_v", digits) + 0.0).alias(name))


def _long_sql(x, name, digits=6):
    return f"SELECT vec_id, CAST(unnest(generate_series(0, len({x}) - 1)) AS INTEGER) AS idx, round(unnest({x}), {digits}) + 0.0 AS {name}"


@query("softmax", f"WITH {_L}, p AS (SELECT vec_id, {_SOFT.format(x='x')} AS p FROM l) {_long_sql('p', 'p')} FROM p")
def softmax(spark, sf_dir):
    return _long(_logits(spark, sf_dir), V.softmax(F.col("x")), "p")


@query("temperature_softmax", f"WITH {_L}, t AS (SELECT vec_id, list_transform(x, lambda v: v / 0.5) AS x FROM l), p AS (SELECT vec_id, {_SOFT.format(x='x')} AS p FROM t) {_long_sql('p', 'p')} FROM p")
def temperature_softmax(spark, sf_dir):
    return _long(_logits(spark, sf_dir), V.softmax(V.temperature(F.col("x"), 0.5)), "p")


@query("top_k", f"WITH {_L}, e AS (SELECT vec_id, unnest(generate_series(0, len(x) - 1)) AS idx, unnest(x) AS v FROM l), r AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY v DESC) AS r FROM e) SELECT vec_id, CAST(idx AS INTEGER) AS idx, round(v, 6) AS logit FROM r WHERE r <= 10")
def top_k(spark, sf_dir):
    kept = V.top_k(F.col("x"), 10)
    return _long(_logits(spark, sf_dir), kept, "logit").where(F.col("logit") > V.NEGATIVE)


@query(
    "top_p",
    f"""WITH {_L}, s AS (SELECT vec_id, list_transform(x, lambda v: v * 8) AS x FROM l), e AS (SELECT vec_id, unnest(generate_series(0, len(x) - 1)) AS idx, unnest(x) AS v FROM s),
    p AS (SELECT *, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id) AS p FROM e), c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY v DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p)
    SELECT vec_id, CAST(idx AS INTEGER) AS idx, round(v, 6) AS logit FROM c WHERE before IS NULL OR before <= 0.9""",
)
def top_p(spark, sf_dir):
    scaled = _logits(spark, sf_dir).select("vec_id", F.transform("x", lambda v: v * 8).alias("x"))
    return _long(scaled, V.top_p(F.col("x"), 0.9), "logit").where(F.col("logit") > V.NEGATIVE)


@query("greedy", f"WITH {_L} SELECT vec_id, CAST(list_position(x, list_max(x)) - 1 AS INTEGER) AS token FROM l")
def greedy(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", V.pick(F.col("x"), "greedy").alias("token"))


@query(
    "multinomial",
    f"""WITH {_L}, e AS (SELECT vec_id, unnest(generate_series(0, len(x) - 1)) AS idx, unnest(x) / 0.7 AS v, CAST('0x' || substr(md5('5:' || vec_id || ':pick'), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM l),
    k AS (SELECT * FROM e QUALIFY rank() OVER (PARTITION BY vec_id ORDER BY v DESC) <= 40), p AS (SELECT *, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id) AS p FROM k),
    c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY v DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
    q AS (SELECT vec_id, idx, u, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id) AS p FROM c WHERE before <= 0.95),
    s AS (SELECT vec_id, idx, u, sum(p) OVER (PARTITION BY vec_id ORDER BY idx) AS upto FROM q)
    SELECT vec_id, CAST(coalesce(min(idx) FILTER (upto > u), 63) AS INTEGER) AS token FROM s GROUP BY vec_id""",
)
def multinomial(spark, sf_dir):
    """Draws with temperature, top-k and top-p, from uniform numbers that depend on the row alone."""
    return _logits(spark, sf_dir).select("vec_id", V.pick(F.col("x"), "sample", 0.7, 40, 0.95, draw(F.col("vec_id"), 5, "pick")).alias("token"))


_PROMPTS = "p AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(abs(CAST(v AS DOUBLE)) * 1000) AS BIGINT) % 97)[1:5] AS ids FROM embeddings)"


def _prompts(spark, sf_dir):
    """Five token ids for each vector."""
    ids = F.transform(F.slice("embedding", 1, 5), lambda v: F.floor(F.abs(v.cast("double")) * 1000) % 97)
    return table(spark, sf_dir, "embeddings").select("vec_id", ids.alias("token_ids"))


def _summing_model():
    """A model whose next token is the sum of its context modulo 97."""
    return lambda ids: np.eye(97)[sum(ids) % 97]


@query(
    "token_steps",
    f"""WITH RECURSIVE {_PROMPTS}, r AS (SELECT vec_id, 0 AS n, ids FROM p
        UNION ALL SELECT vec_id, n + 1, list_append(ids, CAST(list_sum(ids[greatest(len(ids) - 3, 1):]) AS BIGINT) % 97) FROM r WHERE n < 12 AND (n = 0 OR ids[len(ids)] <> 13))
    SELECT vec_id, CAST(n - 1 AS INTEGER) AS step, ids[len(ids)] AS token_id FROM r WHERE n > 0""",
)
def token_steps(spark, sf_dir):
    return M.token_steps(_prompts(spark, sf_dir), "vec_id", _summing_model, 12, 4, eos=13)


@query(
    "generate",
    f"""WITH RECURSIVE {_PROMPTS}, r AS (SELECT vec_id, 0 AS n, ids FROM p
        UNION ALL SELECT vec_id, n + 1, list_append(ids, CAST(list_sum(ids[greatest(len(ids) - 3, 1):]) AS BIGINT) % 97) FROM r WHERE n < 12 AND (n = 0 OR ids[len(ids)] <> 13)),
    m AS (SELECT vec_id, max(n) AS n, arg_max(ids, n) AS ids FROM r GROUP BY vec_id), g AS (SELECT vec_id, ids[6:] AS g FROM m)
    SELECT vec_id, array_to_string(CASE WHEN list_contains(g, 13) THEN g[1:list_position(g, 13) - 1] ELSE g END, ',') AS generated FROM g""",
)
def generate(spark, sf_dir):
    """New ids without the prompt, up to the end token."""
    got = M.generate(_prompts(spark, sf_dir), "vec_id", _summing_model, 12, 4, eos=13)
    return got.select("vec_id", F.array_join(F.transform("generated", lambda x: x.cast("string")), ",").alias("generated"))


@query("generate_and_decode", "SELECT item_id, array_to_string(list_transform(generate_series(0, 9), lambda i: chr(CAST(97 + (strlen(text) + i) % 26 AS INTEGER))), '') AS generated_text FROM benchmark")
def generate_and_decode(spark, sf_dir):
    """Prompts in bytes, continued by a model whose next byte follows from the length of its context."""
    return M.generate_and_decode(table(spark, sf_dir, "benchmark"), "item_id", Bpe(), lambda: lambda ids: np.eye(256)[97 + len(ids) % 26], 10, 1 << 20)


@query("layer_norm", f"WITH {_L}, m AS (SELECT vec_id, x, list_avg(x) AS m, list_avg(list_transform(x, lambda v: v * v)) - list_avg(x) ** 2 AS var FROM l), n AS (SELECT vec_id, list_transform(x, lambda v: (v - m) / sqrt(var + 1e-5)) AS y FROM m) {_long_sql('y', 'y')} FROM n")
def layer_norm(spark, sf_dir):
    return _long(_logits(spark, sf_dir), V.layer_norm(F.col("x")), "y")


@query("rms_norm", f"WITH {_L}, n AS (SELECT vec_id, list_transform(x, lambda v: v / sqrt(list_avg(list_transform(x, lambda u: u * u)) + 1e-6)) AS y FROM l) {_long_sql('y', 'y')} FROM n")
def rms_norm(spark, sf_dir):
    return _long(_logits(spark, sf_dir), V.rms_norm(F.col("x")), "y")


@query("swiglu", f"WITH {_L}, n AS (SELECT vec_id, list_transform(generate_series(1, 32), lambda i: x[i] / (1 + exp(-x[i])) * x[i + 32]) AS y FROM l) {_long_sql('y', 'y')} FROM n")
def swiglu(spark, sf_dir):
    x = F.col("x")
    return _long(_logits(spark, sf_dir), V.swiglu(F.slice(x, 1, 32), F.slice(x, 33, 32)), "y")


@query(
    "rope",
    f"""WITH {_L}, n AS (SELECT vec_id, list_transform(generate_series(0, 63), lambda i: x[i + 1] * cos((vec_id % 100) * pow(10000.0, -(i % 32) / 32.0)) + CASE WHEN i < 32 THEN -x[i + 33] ELSE x[i - 31] END * sin((vec_id % 100) * pow(10000.0, -(i % 32) / 32.0))) AS y FROM l)
    {_long_sql('y', 'y')} FROM n""",
)
def rope(spark, sf_dir):
    return _long(_logits(spark, sf_dir), V.rope(F.col("x"), F.col("vec_id") % 100), "y")


_ERF = "2 / sqrt(pi()) * list_sum(list_transform(generate_series(0, 28), lambda n: CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END * pow(v / sqrt(2), 2 * n + 1) / (factorial(CAST(n AS INTEGER)) * (2 * n + 1))))"


@query("gelu", f"WITH {_L}, n AS (SELECT vec_id, list_transform(x, lambda v: 0.5 * v * (1 + {_ERF})) AS y FROM l) {_long_sql('y', 'y')} FROM n")
def gelu(spark, sf_dir):
    """The SQL sums erf's series, which is exact enough for these values."""
    return _long(_logits(spark, sf_dir), V.gelu(F.col("x")), "y")


@query(
    "mlp",
    f"""WITH {_L}, h AS (SELECT vec_id, list_transform(generate_series(0, 7), lambda j: list_sum(list_transform(generate_series(1, 8), lambda i: x[i] * x[8 + j + 1] + 0.0))) AS h FROM l),
    g AS (SELECT vec_id, list_transform(h, lambda v: 0.5 * v * (1 + {_ERF})) AS g FROM h) SELECT vec_id, round(list_sum(g), 6) + 0.0 AS y FROM g""",
)
def mlp(spark, sf_dir):
    """A feed-forward layer of each vector's own making: inputs x[1..8], weights x[9..16] for all of them, GELU, and a sum."""
    x = F.col("x")
    hidden = F.transform(F.slice(x, 9, 8), lambda w: V.total(F.transform(F.slice(x, 1, 8), lambda v: v * w)))
    rows = _logits(spark, sf_dir).select("vec_id", F.explode(hidden).alias("h")).select("vec_id", V.gelu(F.array("h")).alias("g"))
    return rows.groupBy("vec_id").agg((F.round(F.sum(F.element_at("g", 1)), 6) + 0.0).alias("y"))


_WEIGHTS = f"{_L}, w AS (SELECT CASE vec_id % 4 WHEN 0 THEN 'h.' || vec_id // 4 || '.attn.c_attn.weight' WHEN 1 THEN 'h.' || vec_id // 4 || '.ln_1.bias' WHEN 2 THEN 'h.' || vec_id // 4 || '.mlp.c_fc.weight' ELSE 'h.' || vec_id // 4 || '.attn.masked_bias' END AS name, vec_id % 4 AS kind, vec_id // 4 AS block, x FROM l)"


def _weights(spark, sf_dir):
    """The vectors as weights of a published model: fused matrices of 4 x 12, vectors, matrices of 8 x 8, and a buffer that goes."""
    block = F.floor(F.col("vec_id") / 4).cast("string")
    kinds = [(".attn.c_attn.weight", F.array(F.lit(4), F.lit(12)), F.slice("x", 1, 48)), (".ln_1.bias", F.array(F.lit(64)), F.col("x")), (".mlp.c_fc.weight", F.array(F.lit(8), F.lit(8)), F.col("x")), (".attn.masked_bias", F.array(F.lit(64)), F.col("x"))]
    pick = lambda i: F.element_at(F.array(*[k[i] if i else F.lit(k[0]) for k in kinds]), (F.col("vec_id") % 4 + 1).cast("int"))
    return _logits(spark, sf_dir).select(F.concat(F.lit("h."), block, pick(0)).alias("name"), pick(1).alias("shape"), pick(2).alias("data"))


@query(
    "remap_weights",
    f"""WITH {_WEIGHTS}, t AS (
        SELECT 'blocks.' || block || '.attn.' || part || '_proj.weight' AS name, '4,4' AS shape, list_transform(generate_series(0, 15), lambda k: x[(k % 4) * 12 + f + k // 4 + 1]) AS y FROM w, (VALUES ('q', 0), ('k', 4), ('v', 8)) p(part, f) WHERE kind = 0
        UNION ALL SELECT 'blocks.' || block || '.ln1.shift', '64', x FROM w WHERE kind = 1
        UNION ALL SELECT 'blocks.' || block || '.mlp.fc1.weight', '8,8', list_transform(generate_series(0, 63), lambda k: x[(k % 8) * 8 + k // 8 + 1]) FROM w WHERE kind = 2)
    SELECT name, shape, round(list_sum(list_transform(y, lambda v, i: v * i)), 6) + 0.0 AS checksum FROM t""",
)
def remap_weights(spark, sf_dir):
    got = M.remap_weights(_weights(spark, sf_dir))
    return got.select("name", F.array_join(F.transform("shape", lambda v: v.cast("string")), ",").alias("shape"), (F.round(V.total(F.transform("data", lambda v, i: v * (i + 1))), 6) + 0.0).alias("checksum"))


@query("parameter_groups", f"WITH {_WEIGHTS} SELECT name, CASE WHEN kind IN (0, 2) THEN 0.1 ELSE 0.0 END AS weight_decay FROM w")
def parameter_groups(spark, sf_dir):
    return R.parameter_groups(_weights(spark, sf_dir).select("name"), 0.1)


@query(
    "evaluate",
    """WITH l AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, value, count(*) OVER () AS n FROM events), w AS (SELECT i // 1000 AS evaluation, i % (SELECT any_value(n) FROM l) AS pos FROM (SELECT unnest(generate_series(0, 19999)) AS i))
    SELECT evaluation, round(avg(value), 6) AS mean_loss FROM w JOIN l USING (pos) GROUP BY evaluation""",
)
def evaluate(spark, sf_dir):
    """Events stand in for validation batches: 20 evaluations of 1,000, which go round more than once."""
    events = prefix_sum(table(spark, sf_dir, "events").select("event_id", "value", F.lit(1).alias("one")), "event_id", "one", "pos")
    return R.evaluate(events, "pos", "value", events.count(), 1000, 20).select("evaluation", F.round("mean_loss", 6).alias("mean_loss"))


@query("cadence", "SELECT event_id FROM events WHERE event_id % 100 = 0")
def cadence(spark, sf_dir):
    return R.cadence(table(spark, sf_dir, "events"), "event_id", 100).select("event_id")


@query("gpt2_sizes", "SELECT * FROM (VALUES ('124M', 124.439808), ('355M', 354.823168), ('774M', 774.030080), ('1558M', 1557.611200)) t(size, millions)")
def gpt2_sizes(spark, sf_dir):
    """Parameters of the published models."""
    return spark.createDataFrame([(k, M.gpt2_parameters(k)) for k in M.GPT2_SIZES], "size string, millions double").select("size", F.col("millions").cast("decimal(10,6)").alias("millions"))


def _sequences(spark, sf_dir):
    """The vectors as sequences of 16 positions."""
    return _logits(spark, sf_dir).select(F.floor(F.col("vec_id") / 16).alias("seq"), (F.col("vec_id") % 16).alias("pos"), "x")


_SEQ = f"{_L}, q AS (SELECT vec_id // 16 AS seq, vec_id % 16 AS pos, x FROM l)"


def _attention_sql(heads: int) -> str:
    w = 64 // heads
    return f"""WITH {_SEQ}, h AS (SELECT seq, pos, head, x[head * {w} + 1:head * {w} + {w}] AS x FROM q, (SELECT unnest(generate_series(0, {heads - 1})) AS head)),
    s AS (SELECT a.seq, a.pos, a.head, b.x AS v, list_dot_product(a.x, b.x) / sqrt({w}) AS s FROM h a JOIN h b ON a.seq = b.seq AND a.head = b.head AND b.pos <= a.pos),
    p AS (SELECT *, exp(s - max(s) OVER w) / 1.0 AS e, max(s) OVER w AS m FROM s WINDOW w AS (PARTITION BY seq, pos, head)),
    n AS (SELECT seq, pos, head, e / sum(e) OVER (PARTITION BY seq, pos, head) AS w, v FROM p),
    y AS (SELECT seq, pos, head * {w} + i - 1 AS idx, sum(w * v[i]) AS y FROM n, (SELECT unnest(generate_series(1, {w})) AS i) GROUP BY seq, pos, head, i)
    SELECT seq, pos, CAST(idx AS INTEGER) AS idx, round(y, 5) + 0.0 AS y FROM y"""


def _attention(spark, sf_dir, heads):
    rows = _sequences(spark, sf_dir).select("seq", "pos", F.col("x").alias("q"), F.col("x").alias("k"), F.col("x").alias("v"))
    got = M.attention(rows, "seq", "pos", heads=heads)
    return got.select("seq", "pos", F.posexplode("y").alias("idx", "_y")).select("seq", "pos", "idx", (F.round("_y", 5) + 0.0).alias("y"))


@query("causal_attention", _attention_sql(1))
def causal_attention(spark, sf_dir):
    return _attention(spark, sf_dir, 1)


@query("multi_head_attention", _attention_sql(4))
def multi_head_attention(spark, sf_dir):
    return _attention(spark, sf_dir, 4)


@query("cross_entropy", f"WITH {_L}, e AS (SELECT ln(list_sum(list_transform(x, lambda v: exp(v)))) - x[vec_id % 64 + 1] AS loss FROM l WHERE vec_id % 7 <> 0) SELECT round(avg(loss), 6) AS loss, count(*) AS n FROM e")
def cross_entropy(spark, sf_dir):
    rows = _logits(spark, sf_dir).select(F.col("x").alias("logits"), F.when(F.col("vec_id") % 7 == 0, -100).otherwise(F.col("vec_id") % 64).cast("int").alias("target"))
    return M.cross_entropy(rows).select(F.round("loss", 6).alias("loss"), "n")


@query(
    "embedding_sum",
    f"WITH {_L}, s AS (SELECT a.vec_id, list_transform(generate_series(1, 64), lambda i: a.x[i] + b.x[i]) AS y FROM l a JOIN l b ON b.vec_id = a.vec_id % 16) {_long_sql('y', 'y')} FROM s",
)
def embedding_sum(spark, sf_dir):
    rows = _logits(spark, sf_dir)
    tokens = rows.select("vec_id", F.col("vec_id").alias("token_id"), (F.col("vec_id") % 16).alias("pos"))
    got = M.embed(tokens, rows.select(F.col("vec_id").alias("token_id"), F.col("x").alias("vector")), rows.where("vec_id < 16").select(F.col("vec_id").alias("pos"), F.col("x").alias("vector")), ["vec_id"], 16)
    return _long(got, F.col("x"), "y")


@query("parameter_count", "SELECT count(*) * 64 / 1e6 AS millions FROM embeddings")
def parameter_count(spark, sf_dir):
    return M.parameter_count(_logits(spark, sf_dir).select(F.col("x").alias("data")))


@query("learning_rates", "SELECT i AS iter, round(CASE WHEN i < 100 THEN 6e-4 * (i + 1) / 101 WHEN i > 1000 THEN 6e-5 ELSE 6e-5 + 0.5 * (1 + cos(pi() * (i - 100) / 900.0)) * (6e-4 - 6e-5) END, 12) AS lr FROM (SELECT unnest(generate_series(0, 1199)) AS i)")
def learning_rates(spark, sf_dir):
    return R.learning_rates(spark, 1200, 6e-4, 100, 1000, 6e-5).select("iter", F.round("lr", 12).alias("lr"))


@query("best_so_far", "SELECT user_id, event_id, coalesce(value < min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM events")
def best_so_far(spark, sf_dir):
    """Events stand in for evaluation steps."""
    return R.best_so_far(table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("user_id", "event_id", "is_best")


_ROUTED = f"""{_L}, c AS (SELECT vec_id, x, unnest(generate_series(0, 7)) AS expert, unnest(x[1:8]) AS logit FROM l),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, expert) - 1 AS choice FROM c), k AS (SELECT *, exp(logit) / sum(exp(logit)) OVER (PARTITION BY vec_id) AS gate FROM r WHERE choice < 2),
    p AS (SELECT *, row_number() OVER (PARTITION BY expert ORDER BY choice, vec_id) - 1 AS place, (SELECT CAST(ceil(count(*) * 2 / 8.0) AS BIGINT) FROM l) AS most FROM k)"""


def _routed(spark, sf_dir):
    rows = _logits(spark, sf_dir)
    return E.route(rows.select("vec_id", "x", F.slice("x", 1, 8).alias("logits")), "vec_id", "logits", "x", 2, E.capacity(rows.count(), 8, 2))


@query("expert_routing", f"WITH {_ROUTED} SELECT vec_id AS token, CAST(choice AS INTEGER) AS choice, CAST(expert AS INTEGER) AS expert, round(gate, 6) AS gate, place, place < most AS sent FROM p")
def expert_routing(spark, sf_dir):
    """Two of eight experts for each vector, whose first components are the router's logits; every expert takes its even share."""
    return _routed(spark, sf_dir).select("token", F.col("choice").cast("int").alias("choice"), "expert", F.round("gate", 6).alias("gate"), "place", "sent")


@query(
    "expert_outputs",
    f"WITH {_ROUTED}, w AS (SELECT vec_id AS expert, x AS w FROM l WHERE vec_id < 8), y AS (SELECT vec_id AS token, i - 1 AS idx, sum(CASE WHEN place < most THEN gate * x[i] * w[i] ELSE 0 END) AS y FROM p JOIN w USING (expert), (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY vec_id, i) SELECT token, CAST(idx AS INTEGER) AS idx, round(y, 6) + 0.0 AS y FROM y",
)
def expert_outputs(spark, sf_dir):
    """What the experts (a vector each, multiplied component by component) return for the tokens they take, weighted and summed."""
    experts = _logits(spark, sf_dir).where("vec_id < 8").select(F.col("vec_id").alias("expert"), F.col("x").alias("weights"))
    got = E.combine(_routed(spark, sf_dir), experts, lambda x, w: F.zip_with(x, w, lambda a, b: a * b))
    return got.select("token", F.posexplode("y").alias("idx", "_y")).select("token", "idx", (F.round("_y", 6) + 0.0).alias("y"))


def _block_sql() -> str:
    """A block on sequences of 16 vectors of 16 components; the weights are parts of the first 96 vectors, a tenth of them."""
    def table(first, n, a, b):
        return f"(SELECT list(list_transform(x[{a}:{b}], lambda v: v / 10) ORDER BY vec_id) FROM l WHERE vec_id >= {first} AND vec_id < {first + n})"

    def times(x, w, n_in, n_out):
        return f"list_transform(generate_series(1, {n_out}), lambda j: list_sum(list_transform(generate_series(1, {n_in}), lambda i: {x}[i] * {w}[i][j])))"

    def norm(x):
        return f"list_transform({x}, lambda v: (v - list_avg({x})) / sqrt(list_avg(list_transform({x}, lambda u: (u - list_avg({x})) * (u - list_avg({x})))) + 1e-5))"

    add = lambda x, y: f"list_transform(generate_series(1, 16), lambda i: {x}[i] + {y}[i])"
    return f"""WITH {_L}, w AS (SELECT {table(0, 16, 1, 16)} AS wq, {table(0, 16, 17, 32)} AS wk, {table(0, 16, 33, 48)} AS wv, {table(0, 16, 49, 64)} AS wo, {table(16, 16, 1, 64)} AS w1, {table(32, 64, 1, 16)} AS w2),
    t AS (SELECT vec_id // 16 AS seq, vec_id % 16 AS pos, x[1:16] AS x FROM l), n AS (SELECT seq, pos, x, {norm('x')} AS h FROM t),
    p AS (SELECT seq, pos, x, {times('h', 'wq', 16, 16)} AS q, {times('h', 'wk', 16, 16)} AS k, {times('h', 'wv', 16, 16)} AS v FROM n, w),
    s AS (SELECT a.seq, a.pos, head, exp(list_dot_product(a.q[head * 4 + 1:head * 4 + 4], b.k[head * 4 + 1:head * 4 + 4]) / 2) AS e, b.v[head * 4 + 1:head * 4 + 4] AS v FROM p a JOIN p b ON a.seq = b.seq AND b.pos <= a.pos, (SELECT unnest(generate_series(0, 3)) AS head)),
    o AS (SELECT seq, pos, head, i, sum(e * v[i]) / sum(e) AS y FROM s, (SELECT unnest(generate_series(1, 4)) AS i) GROUP BY ALL), y AS (SELECT seq, pos, list(y ORDER BY head, i) AS y FROM o GROUP BY seq, pos),
    r AS (SELECT seq, pos, x, {times('y', 'wo', 16, 16)} AS y FROM y JOIN p USING (seq, pos), w), m AS (SELECT seq, pos, {add('x', 'y')} AS x FROM r), f AS (SELECT seq, pos, x, {norm('x')} AS h FROM m),
    u AS (SELECT seq, pos, x, {times('h', 'w1', 16, 64)} AS u FROM f, w), g AS (SELECT seq, pos, x, list_transform(u, lambda v: 0.5 * v * (1 + {_ERF})) AS g FROM u), d AS (SELECT seq, pos, x, {times('g', 'w2', 64, 16)} AS y FROM g, w)
    SELECT seq, pos, CAST(unnest(generate_series(0, 15)) AS INTEGER) AS idx, round(unnest({add('x', 'y')}), 5) + 0.0 AS y FROM d"""


@query("transformer_block", _block_sql())
def transformer_block(spark, sf_dir):
    """A pre-norm block of four heads; its weights are parts of the first 96 vectors."""
    rows = _logits(spark, sf_dir)
    part = lambda first, n, a, size: rows.where(f"vec_id >= {first} AND vec_id < {first + n}").select((F.col("vec_id") - first).alias("i"), F.transform(F.slice("x", a, size), lambda v: v / 10).alias("row"))
    weights = {"q_proj": part(0, 16, 1, 16), "k_proj": part(0, 16, 17, 16), "v_proj": part(0, 16, 33, 16), "out_proj": part(0, 16, 49, 16), "fc1": part(16, 16, 1, 64), "fc2": part(32, 64, 1, 16)}
    given = _sequences(spark, sf_dir).select("seq", "pos", F.slice("x", 1, 16).alias("x"))
    got = tiles.transformer_block(given, weights, 4)
    return got.select("seq", "pos", F.posexplode("y").alias("idx", "_y")).select("seq", "pos", "idx", (F.round("_y", 5) + 0.0).alias("y"))
