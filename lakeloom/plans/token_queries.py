"""Queries on byte-pair encoding and token streams."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from lakeloom.functions.text import byte_ids, fast_byte_ids
from lakeloom.operators import blocks as B
from lakeloom.operators import bpe as P
from lakeloom.operators import stream_bpe
from lakeloom.operators.ranking import prefix_sum
from lakeloom.sources import files
from lakeloom.sources.tables import table, texts

from .base import query, scratch
from .text_queries import _GPT4

SENTENCE = "Hello world! This is a test. Hello everyone."


@lru_cache(maxsize=1)
def small_bpe() -> P.Bpe:
    """24 merges of one sentence, with the default special token."""
    import regex

    words: dict[str, list] = {}
    for w in regex.findall(P.GPT4_PATTERN, SENTENCE):
        words.setdefault(w, [list(w.encode()), 0])[1] += 1
    return P.Bpe(P.learn([(a, n) for a, n in words.values()], 24), dict(P.DEFAULT_SPECIALS))


def _hex(x: str) -> str:
    return rf"regexp_replace(hex(encode({x})), '(..)', '<\1>', 'g')"


def _merged(x: str) -> str:
    """SQL: all merges on tokens in angle brackets."""
    name = lambda i: f"{i:02X}" if i < 256 else f"m{i}"
    for k, (a, b) in enumerate(small_bpe().merges):
        x = f"replace({x}, '<{name(a)}><{name(b)}>', '<m{256 + k}>')"
    return x


_IDS = r"list_transform(regexp_extract_all(s, '<([^>]*)>', 1), lambda t: CASE WHEN t LIKE 'm%' THEN CAST(substr(t, 2) AS BIGINT) ELSE CAST('0x' || t AS BIGINT) END)"


def _ids_of(name: str, key: str) -> str:
    joined = f"array_to_string(list_transform({_GPT4}, lambda c: {_hex('c')}), '|')"
    return f"j AS (SELECT {key}, {_merged(joined)} AS s FROM {name}), t AS (SELECT {key}, {_IDS} AS ids FROM j)"


@query(
    "byte_pair_counts",
    f"""WITH c AS (SELECT unnest({_GPT4}) AS chunk FROM documents), d AS (SELECT hex(encode(chunk)) AS h, count(*) AS n FROM c GROUP BY chunk),
    p AS (SELECT unnest(list_transform(generate_series(1, len(h) // 2 - 1), lambda i: substr(h, 2 * i - 1, 4))) AS pair, n FROM d WHERE len(h) > 2)
    SELECT CAST('0x' || pair[1:2] AS INTEGER) AS left_id, CAST('0x' || pair[3:4] AS INTEGER) AS right_id, CAST(sum(n) AS BIGINT) AS total FROM p GROUP BY pair""",
)
def byte_pair_counts(spark, sf_dir):
    got = P.pair_counts(P.chunk_counts(texts(spark, sf_dir), "doc_id"))
    return got.select(P.id_of(F.substring("pair", 1, 1)).alias("left_id"), P.id_of(F.substring("pair", 2, 1)).alias("right_id"), "total")


@query(
    "byte_split",
    "SELECT item_id, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(list_sum(list_transform(generate_series(1, CAST(strlen(text) AS BIGINT)), lambda i: i * CAST('0x' || substr(hex(encode(text)), CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT))) AS BIGINT) AS checksum FROM benchmark",
)
def byte_split(spark, sf_dir):
    """The historic encoder without a pre-tokenizer: raw bytes."""
    ids = table(spark, sf_dir, "benchmark").select("item_id", byte_ids(F.col("text")).alias("ids"))
    return ids.select("item_id", F.size("ids").cast("long").alias("n_bytes"), F.aggregate(F.transform("ids", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"))


@query(
    "bpe_encode",
    f"""WITH j AS (SELECT doc_id, {_merged(f"array_to_string(list_transform({_GPT4}, lambda c: {_hex('c')}), '|')")} AS s FROM documents), t AS (SELECT doc_id, {_IDS} AS ids FROM j)
    SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens, CAST(list_sum(list_transform(ids, lambda x, i: x * (i % 1000))) AS BIGINT) AS checksum FROM t""",
)
def bpe_encode(spark, sf_dir):
    return token_sums(texts(spark, sf_dir).select("doc_id", P.encode_cached(F.col("text"), small_bpe()).alias("ids")), "ids", "doc_id")


def token_sums(df, ids, *keys):
    """Number and weighted sum of each row's token ids."""
    weighted = F.aggregate(F.transform(ids, lambda x, i: x.cast("long") * ((i + 1) % 1000)), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select(*keys, F.size(ids).cast("long").alias("n_tokens"), weighted.alias("checksum"))


@query(
    "bpe_encode_native",
    f"""WITH j AS (SELECT item_id, {_merged(f"array_to_string(list_transform({_GPT4}, lambda c: {_hex('c')}), '|')")} AS s FROM benchmark), t AS (SELECT item_id, {_IDS} AS ids FROM j)
    SELECT item_id, CAST(len(ids) AS BIGINT) AS n_tokens, CAST(list_sum(list_transform(ids, lambda x, i: x * (i % 1000))) AS BIGINT) AS checksum FROM t""",
)
def bpe_encode_native(spark, sf_dir):
    """The same from native expressions only, which suits few merges."""
    return token_sums(table(spark, sf_dir, "benchmark").select("item_id", P.encode(F.col("text"), small_bpe()).alias("ids")), "ids", "item_id")


def published(name: str = "byte_bpe_50k.tiktoken") -> bytes:
    """A published ranks file; LAKELOOM_TOKENIZERS names another folder."""
    import os

    with open(f"{os.environ.get('LAKELOOM_TOKENIZERS', '/opt/tokenizers')}/{name}", "rb") as f:
        return f.read()


LARGE = 2000


@lru_cache(maxsize=1)
def published_bpe() -> P.Bpe:
    """All merges of a published vocabulary."""
    return P.from_ranks(P.read_ranks(published()))


@lru_cache(maxsize=1)
def large_bpe() -> P.Bpe:
    """The first 2,000 merges of a published vocabulary."""
    return P.from_ranks(P.read_ranks(published()), most=LARGE)


def _large_sql() -> str:
    """Distinct chunks as strings of one character for each token, from U+1000 on; merges are replacements in order."""
    char = lambda i: chr(0x1000 + i)
    rules = ", ".join(f"'{char(a)}{char(b)}{char(256 + k)}'" for k, (a, b) in enumerate(large_bpe().merges))
    return f"""WITH c AS (SELECT doc_id, unnest({_GPT4}) AS chunk, unnest(generate_series(1, len({_GPT4}))) AS seq FROM documents),
    d AS (SELECT DISTINCT chunk FROM c),
    b AS (SELECT chunk, array_to_string(list_transform(generate_series(1, CAST(strlen(chunk) AS BIGINT)), lambda i: chr(4096 + CAST('0x' || substr(hex(encode(chunk)), CAST(2 * i - 1 AS BIGINT), 2) AS INTEGER))), '') AS s FROM d),
    m AS (SELECT chunk, list_reduce([{rules}], lambda t, r: replace(t, r[1:2], r[3]), s) AS s FROM b),
    t AS (SELECT chunk, list_transform(generate_series(1, length(s)), lambda i: CAST(unicode(s[i]) - 4096 AS BIGINT)) AS ids FROM m),
    r AS (SELECT doc_id, flatten(list(ids ORDER BY seq)) AS ids FROM c JOIN t USING (chunk) GROUP BY doc_id)
    SELECT doc_id, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_tokens, CAST(coalesce(list_sum(list_transform(ids, lambda x, i: x * (i % 1000))), 0) AS BIGINT) AS checksum FROM documents LEFT JOIN r USING (doc_id)"""


@query("bpe_encode_large", _large_sql)
def bpe_encode_large(spark, sf_dir):
    """Documents with 2,000 merges of a published vocabulary."""
    return token_sums(texts(spark, sf_dir).select("doc_id", P.encode_cached(F.col("text"), large_bpe()).alias("ids")), "ids", "doc_id")


@query("published_round_trip", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def published_round_trip(spark, sf_dir):
    """Documents encoded with the whole published vocabulary of 50,256 tokens, and decoded again."""
    bpe = published_bpe()
    coded = texts(spark, sf_dir).select("doc_id", P.encode_cached(F.col("text"), bpe).alias("ids"))
    return coded.select("doc_id", F.sha2(P.decode_cached(F.col("ids"), bpe), 256).alias("sha256"))


def _published_sql() -> str:
    """Distinct chunks as lists of ids; in a step each chunk does the first of its merges of lowest rank."""
    ranks = ", ".join(f"({a},{b},{256 + k})" for k, (a, b) in enumerate(published_bpe().merges))
    return f"""WITH RECURSIVE m(a, b, new) AS (VALUES {ranks}), c AS (SELECT doc_id, unnest({_GPT4}) AS chunk, unnest(generate_series(1, len({_GPT4}))) AS seq FROM documents),
    d AS (SELECT row_number() OVER () AS no, chunk, list_transform(regexp_extract_all(hex(encode(chunk)), '..'), lambda x: CAST('0x' || x AS INTEGER)) AS ids FROM (SELECT DISTINCT chunk FROM c)),
    r AS (SELECT no, ids, false AS over FROM d
        UNION ALL (WITH p AS (SELECT no, unnest(ids) AS a, unnest(ids[2:]) AS b, unnest(generate_series(1, len(ids))) AS i FROM r WHERE NOT over),
            best AS (SELECT no, min((new, i)) AS f FROM p JOIN m USING (a, b) GROUP BY no)
        SELECT r.no, CASE WHEN f IS NULL THEN ids ELSE list_concat(ids[1:f[2] - 1], [f[1]], ids[f[2] + 2:]) END, f IS NULL FROM r LEFT JOIN best USING (no) WHERE NOT over)),
    t AS (SELECT chunk, r.ids FROM r JOIN d USING (no) WHERE over),
    o AS (SELECT doc_id, flatten(list(ids ORDER BY seq)) AS ids FROM c JOIN t USING (chunk) GROUP BY doc_id)
    SELECT doc_id, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_tokens, CAST(coalesce(list_sum(list_transform(ids, lambda x, i: x * (i % 1000))), 0) AS BIGINT) AS checksum FROM documents LEFT JOIN o USING (doc_id)"""


@query("published_encode", _published_sql)
def published_encode(spark, sf_dir):
    """Ids of documents with all 50,000 merges of a published vocabulary."""
    return token_sums(texts(spark, sf_dir).select("doc_id", P.encode_cached(F.col("text"), published_bpe()).alias("ids")), "ids", "doc_id")


@query("bpe_decode", "SELECT doc_id, sha256(text || '<|endoftext|>' || text) AS sha256 FROM documents")
def bpe_decode(spark, sf_dir):
    """Encoding with a special token, and back."""
    joined = F.concat("text", F.lit("<|endoftext|>"), "text")
    ids = texts(spark, sf_dir).select("doc_id", P.encode_cached(joined, small_bpe()).alias("ids"))
    return ids.select("doc_id", F.sha2(P.decode_cached(F.col("ids"), small_bpe()), 256).alias("sha256"))


@query("bpe_special_tokens", f"WITH {_ids_of('documents', 'doc_id')} SELECT doc_id, CAST(2 * len(ids) + 1 AS BIGINT) AS n_tokens, CAST(2 * list_sum(ids) + 100257 AS BIGINT) AS total, CAST(len(ids) AS BIGINT) AS first_special FROM t")
def bpe_special_tokens(spark, sf_dir):
    """A special token between a text and itself is one id, and what is around it is encoded as if alone."""
    joined = F.concat("text", F.lit("<|endoftext|>"), "text")
    ids = texts(spark, sf_dir).select("doc_id", P.encode_cached(joined, small_bpe()).alias("ids"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), (F.array_position("ids", 100257) - 1).cast("long").alias("first_special"))


@query("naive_bpe_encode", f"""WITH j AS (SELECT doc_id, {_merged(_hex('text'))} AS s FROM documents), t AS (SELECT doc_id, {_IDS} AS ids FROM j) SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens, CAST(list_sum(list_transform(ids, lambda x, i: x * (i % 1000))) AS BIGINT) AS checksum FROM t""")
def naive_bpe_encode(spark, sf_dir):
    """Merges over whole texts, without a pre-tokenizer."""
    return token_sums(texts(spark, sf_dir).select("doc_id", P.naive_encode(F.col("text"), small_bpe()).alias("ids")), "ids", "doc_id")


def _train_sql(n: int) -> str:
    """n merges of the documents by recursion: a token is one character (U+0100 + its id), a merge one replacement in every distinct chunk."""
    return f"""WITH RECURSIVE c AS (SELECT doc_id, unnest({_GPT4}) AS chunk, unnest(generate_series(1, len({_GPT4}))) AS seq FROM documents),
    d AS (SELECT chunk, count(*) AS n, min((doc_id, seq)) AS first FROM c GROUP BY chunk HAVING strlen(chunk) > 1),
    start AS (SELECT n, row_number() OVER (ORDER BY first) AS place, array_to_string(list_transform(generate_series(1, CAST(strlen(chunk) AS BIGINT)), lambda i: chr(256 + CAST('0x' || substr(hex(encode(chunk)), CAST(2 * i - 1 AS BIGINT), 2) AS INTEGER))), '') AS s FROM d),
    r AS (SELECT 0 AS k, '' AS best, n, place, s FROM start
        UNION ALL (WITH p AS (SELECT n, place, s, unnest(list_transform(generate_series(1, length(s) - 1), lambda i: s[i:i + 1])) AS pair, unnest(generate_series(1, length(s) - 1)) AS i FROM r),
            q AS (SELECT pair, place, n, count(*) AS here, min(i) AS i FROM p GROUP BY pair, place, n),
            w AS (SELECT pair, sum(n * here) AS total, min((place, -here, i)) AS tie FROM q GROUP BY pair),
            top AS (SELECT pair FROM w ORDER BY total DESC, tie LIMIT 1)
        SELECT k + 1, pair, n, place, replace(s, pair, chr(512 + k)) FROM r, top WHERE k < {n}))
    SELECT DISTINCT CAST(k - 1 AS INTEGER) AS rank, CAST(unicode(best[1]) - 256 AS INTEGER) AS left_id, CAST(unicode(best[2]) - 256 AS INTEGER) AS right_id, CAST(255 + k AS INTEGER) AS new_id FROM r WHERE k > 0"""


@query("bpe_train", _train_sql(64))
def bpe_train(spark, sf_dir):
    """The first 64 merges of the documents in order."""
    got = P.train(texts(spark, sf_dir), "doc_id", 256 + 64)
    return spark.createDataFrame([(k, a, b, 256 + k) for k, (a, b) in enumerate(got.merges)], "rank int, left_id int, right_id int, new_id int")


@query("bpe_train_distributed", _train_sql(128))
def bpe_train_distributed(spark, sf_dir):
    """The first 128 merges by rounds of distributed jobs, whatever the number of distinct chunks."""
    got = P.train(texts(spark, sf_dir), "doc_id", 256 + 128, on_driver=0)
    return spark.createDataFrame([(k, a, b, 256 + k) for k, (a, b) in enumerate(got.merges)], "rank int, left_id int, right_id int, new_id int")


def _naive_train_sql(n: int) -> str:
    """n merges of one string, a character (U+0100 + its id) for each token."""
    return f"""WITH RECURSIVE b AS (SELECT hex(encode(string_agg(text, '' ORDER BY doc_id))) AS h FROM documents),
    r AS (SELECT 0 AS k, '' AS best, array_to_string(list_transform(regexp_extract_all(h, '..'), lambda x: chr(256 + CAST('0x' || x AS INTEGER))), '') AS s FROM b
        UNION ALL (WITH c AS (SELECT regexp_extract_all(s, '(?s).') AS l FROM r), u AS (SELECT unnest(l) AS a, unnest(l[2:]) AS b, unnest(generate_series(1, len(l))) AS i FROM c),
            top AS (SELECT a || b AS pair FROM u WHERE b IS NOT NULL GROUP BY pair ORDER BY count(*) DESC, min(i) LIMIT 1)
        SELECT k + 1, pair, replace(s, pair, chr(512 + k)) FROM r, top WHERE k < {n}))
    SELECT CAST(k - 1 AS INTEGER) AS rank, CAST(unicode(best[1]) - 256 AS INTEGER) AS left_id, CAST(unicode(best[2]) - 256 AS INTEGER) AS right_id, CAST(255 + k AS INTEGER) AS new_id FROM r WHERE k > 0"""


@query("naive_bpe_train", _naive_train_sql(32))
def naive_bpe_train(spark, sf_dir):
    """The first 32 merges of all documents as one unbroken stream of bytes."""
    got = stream_bpe.train(table(spark, sf_dir, "documents"), "doc_id", 32)
    return spark.createDataFrame([(k, a, b, 256 + k) for k, (a, b) in enumerate(got)], "rank int, left_id int, right_id int, new_id int")


def _vocabulary_sql() -> str:
    """Tokens' bytes, put together from the merges one after the other."""
    merges = small_bpe().merges
    steps = [f"v{k} AS (SELECT * FROM {'b' if k == 0 else f'v{k - 1}'} UNION ALL SELECT {256 + k}, x.hex || y.hex FROM {'b' if k == 0 else f'v{k - 1}'} x, {'b' if k == 0 else f'v{k - 1}'} y WHERE x.id = {a} AND y.id = {b})" for k, (a, b) in enumerate(merges)]
    return f"WITH b AS (SELECT CAST(id AS INTEGER) AS id, printf('%02X', id) AS hex FROM (SELECT unnest(generate_series(0, 255)) AS id)), {', '.join(steps)} SELECT id, hex FROM v{len(merges) - 1}"


@query("tokenizer_file", _vocabulary_sql)
def tokenizer_file(spark, sf_dir):
    """A tokenizer saved as JSON: the tokens of the file that is read again."""
    path = scratch(spark, "tokenizer") + ".json"
    files.write_bytes(spark, path, small_bpe().to_json().encode())
    back = P.Bpe.from_json(files.read_bytes(spark, path).decode())
    return spark.createDataFrame([(i, b.hex().upper()) for i, b in back.vocabulary.items()], "id int, hex string")


@query("tokenizer_readable", f"WITH t AS ({_vocabulary_sql()}) SELECT CAST(id AS INTEGER) AS id, decode(unhex(hex)) AS shown FROM t WHERE regexp_full_match(hex, '(2[0-9A-F]|[3-6][0-9A-F]|7[0-9A-E])+')")
def tokenizer_readable(spark, sf_dir):
    """The readable form of the tokens of printable ASCII, read from its lines."""
    path = scratch(spark, "readable")
    files.write_bytes(spark, f"{path}/tokenizer.txt", small_bpe().readable().encode())
    lines = spark.read.text(f"{path}/tokenizer.txt")
    parsed = lines.select(F.regexp_extract("value", r"^\s*(\d+): (.*)$", 1).alias("id"), F.regexp_extract("value", r"^\s*(\d+): (.*)$", 2).alias("shown")).where("id <> ''")
    return parsed.where(F.col("shown").rlike(r"^[\x20-\x7E]+$") & ~F.col("shown").rlike(r"^\\")).select(F.col("id").cast("int").alias("id"), "shown").unionByName(parsed.where(F.col("shown") == "\\").select(F.col("id").cast("int").alias("id"), "shown"))


@query(
    "bpe_first_merge",
    f"""WITH c AS (SELECT doc_id, unnest({_GPT4}) AS chunk, unnest(generate_series(1, len({_GPT4}))) AS seq FROM documents),
    d AS (SELECT hex(encode(chunk)) AS h, count(*) AS n, min((doc_id, seq)) AS first FROM c GROUP BY chunk),
    p AS (SELECT first, n, unnest(list_transform(generate_series(1, len(h) // 2 - 1), lambda i: substr(h, 2 * i - 1, 4))) AS pair, unnest(generate_series(1, len(h) // 2 - 1)) AS i FROM d WHERE len(h) > 2),
    q AS (SELECT pair, first, n, count(*) AS here, min(i) AS i FROM p GROUP BY pair, first, n),
    r AS (SELECT pair, sum(n * here) AS total, min((first, -here, i)) AS tie FROM q GROUP BY pair)
    SELECT CAST('0x' || pair[1:2] AS INTEGER) AS left_id, CAST('0x' || pair[3:4] AS INTEGER) AS right_id, CAST(total AS BIGINT) AS total FROM r ORDER BY r.total DESC, tie LIMIT 1""",
)
def bpe_first_merge(spark, sf_dir):
    got = P.pair_counts(P.chunk_counts(texts(spark, sf_dir), "doc_id")).orderBy(F.desc("total"), "tie").limit(1)
    return got.select(P.id_of(F.substring("pair", 1, 1)).alias("left_id"), P.id_of(F.substring("pair", 2, 1)).alias("right_id"), "total")


def _stream(spark, sf_dir):
    docs = texts(spark, sf_dir).select("doc_id", fast_byte_ids(F.col("text")).alias("token_ids"))
    return B.positions(docs, "doc_id")


@query("token_positions", "SELECT doc_id, CAST(coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(strlen(text) AS BIGINT) AS n FROM documents")
def token_positions(spark, sf_dir):
    return _sizes(spark, sf_dir)


_BYTES = """b AS (SELECT string_agg(text, '' ORDER BY doc_id) AS t FROM documents), h AS (SELECT hex(encode(t)) AS h, CAST(strlen(t) AS BIGINT) AS n, CAST(floor(strlen(t) * 0.9) AS BIGINT) AS cut FROM b)"""


@query("train_val_split", f"WITH {_BYTES} SELECT 'train' AS split, cut AS n_tokens FROM h UNION ALL SELECT 'val', n - cut FROM h")
def train_val_split(spark, sf_dir):
    placed = _sizes(spark, sf_dir)
    return B.split_sizes(placed, int(placed.agg(F.sum("n")).first()[0] or 0), 0.9)


def _sizes(spark, sf_dir):
    """Documents' places in the stream of bytes, without the bytes."""
    return prefix_sum(table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")), "doc_id", "n", "start").select("doc_id", "start", "n")


@query(
    "training_blocks",
    """WITH b AS (SELECT string_agg(text, '' ORDER BY doc_id) AS t FROM documents), h AS (SELECT regexp_extract_all(hex(encode(t)), '.{130}') AS rows_ FROM b),
    r AS (SELECT unnest(rows_) AS row_hex, unnest(generate_series(0, len(rows_) - 1)) AS block, len(rows_) // 8 * 8 AS n FROM h),
    s AS (SELECT block, row_hex FROM r WHERE block < n)
    SELECT CAST(block // 8 AS BIGINT) AS batch_id, CAST(block % 8 AS INTEGER) AS row, CAST('0x' || row_hex[1:2] AS BIGINT) AS first_x, CAST('0x' || row_hex[129:130] AS BIGINT) AS last_y,
        CAST(list_sum(list_transform(generate_series(1, 64), lambda i: i * CAST('0x' || substr(row_hex, 2 * i - 1, 2) AS BIGINT))) AS BIGINT) AS x_checksum FROM s""",
)
def training_blocks(spark, sf_dir):
    got = B.packed_batches(table(spark, sf_dir, "documents"), "doc_id", F.encode("text", "UTF-8"), 64, 8)
    checksum = F.aggregate(F.transform("x", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return got.select("batch_id", "row", F.element_at("x", 1).cast("long").alias("first_x"), F.element_at("y", -1).cast("long").alias("last_y"), checksum.alias("x_checksum"))


@query("epoch_length", "SELECT CAST(sum(strlen(text)) AS BIGINT) AS n_tokens, CAST(sum(strlen(text)) // (8 * 65) AS BIGINT) AS n_batches FROM documents")
def epoch_length(spark, sf_dir):
    n = int(_sizes(spark, sf_dir).agg(F.sum("n")).first()[0] or 0)
    return spark.createDataFrame([(n, B.epoch_batches(n, 64, 8))], "n_tokens long, n_batches long")


def _refill_sql() -> str:
    """The historic buffer of 1,000 tokens, step by step on row numbers: each batch of 260 tokens, refilled when fewer are held."""
    return """WITH RECURSIVE b AS (SELECT string_agg(text, '' ORDER BY doc_id) AS t FROM documents), h AS (SELECT regexp_extract_all(hex(encode(t)), '..') AS bytes, CAST(strlen(t) AS BIGINT) AS n FROM b), size AS (SELECT n FROM h),
    -- held: tokens in the buffer, which end at position `read` of the endless repetition of the data; refills drop the oldest beyond 1000
    s AS (SELECT CAST(-1 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS read, CAST(0 AS BIGINT) AS start
        UNION ALL SELECT batch + 1,
            CASE WHEN held < 260 THEN least(held + take, 1000) - 260 ELSE held - 260 END,
            CASE WHEN held < 260 THEN read + take ELSE read END,
            CASE WHEN held < 260 THEN read + take - least(held + take, 1000) ELSE read - held END
        FROM (SELECT *, least(1000, n - read % n) AS take FROM s, size) WHERE batch + 1 < n // 260),
    rows_ AS (SELECT batch, r AS row, start + r * 65 AS begin_ FROM s, (SELECT unnest(generate_series(0, 3)) AS r) WHERE batch >= 0),
    p AS (SELECT batch, row, i, (begin_ + i) % n AS pos FROM rows_, size, (SELECT unnest(generate_series(0, 64)) AS i)),
    k AS (SELECT unnest(bytes) AS byte, unnest(generate_series(0, n - 1)) AS pos FROM h)
    SELECT batch AS batch_id, CAST(row AS INTEGER) AS row, CAST(sum(CASE WHEN i < 64 THEN (i + 1) * CAST('0x' || byte AS BIGINT) ELSE 0 END) AS BIGINT) AS x_checksum,
        CAST(sum(CASE WHEN i > 0 THEN i * CAST('0x' || byte AS BIGINT) ELSE 0 END) AS BIGINT) AS y_checksum FROM p JOIN k USING (pos) GROUP BY batch, row"""


@query("refill_batches", _refill_sql())
def refill_batches(spark, sf_dir):
    """A whole epoch of the historic loader."""
    placed = _stream(spark, sf_dir)
    n = int(_sizes(spark, sf_dir).agg(F.sum("n")).first()[0] or 0)
    got = B.refill_batches(placed, n, B.LoaderConfig(64, 4, 1000))
    checksum = lambda c: F.aggregate(F.transform(c, lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return got.select("batch_id", "row", checksum("x").alias("x_checksum"), checksum("y").alias("y_checksum"))
