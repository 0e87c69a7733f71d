"""Queries on sources and sinks: what is written is read again, and compared with the tables it came from."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions.text import chunks
from lakeloom.operators import blocks as B
from lakeloom.operators import bpe as P
from lakeloom.operators import documents as D
from lakeloom.operators import instruct as I
from lakeloom.operators import wordvocab as V
from lakeloom.sources import datasets, files, weights
from lakeloom.sources.tables import table

from .base import query, scratch
from .instruct_queries import _RAW, _ROWS, _raw, _samples
from .text_queries import _VOCAB_3

_KEYED = "conv_id long, turn int, " + files.SAMPLE


@query("text_files", r"SELECT item_id, regexp_replace(text, '\r\n?', chr(10), 'g') || chr(10) AS text FROM benchmark")
def text_files(spark, sf_dir):
    """A folder for each item with one text file, read whole; newlines are made equal."""
    path = scratch(spark, "texts")
    table(spark, sf_dir, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    got = files.read_text(spark, f"{path}/*/*.txt")
    return got.select(F.regexp_extract("path", "item_id=([^/]*)", 1).alias("item_id"), "text")


@query("json_array", f"WITH {_ROWS} SELECT * FROM samples")
def json_array(spark, sf_dir):
    """Samples as one JSON array."""
    path = scratch(spark, "array") + ".json"
    files.write_json_array(_samples(spark, sf_dir).select("conv_id", "turn", "instruction", "input", "output"), path)
    return files.read_json(spark, path, _KEYED, indent=2)


@query("json_lines", f"WITH {_ROWS} SELECT * FROM samples UNION ALL SELECT * FROM samples")
def json_lines(spark, sf_dir):
    """Samples as JSON lines, written and appended."""
    path = scratch(spark, "lines") + ".jsonl"
    rows = _samples(spark, sf_dir).select("conv_id", "turn", "instruction", "input", "output")
    files.write_json(rows, path)
    files.append_json(rows, path)
    return files.read_json(spark, path, _KEYED)


@query("json_unescaped", f"WITH {_ROWS} SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(length(instruction || input || output)) AS BIGINT) AS characters, CAST(sum(strlen(instruction || input || output)) AS BIGINT) AS bytes, 0 AS escapes FROM samples")
def json_unescaped(spark, sf_dir):
    """An array with escapes rewritten without: the texts stay, the escapes of other than ASCII characters go."""
    path = scratch(spark, "escaped")
    files.write_json_array(_samples(spark, sf_dir).select("instruction", "input", "output"), f"{path}.json", escaped=True)
    files.rewrite_unescaped(spark, f"{path}.json", f"{path}-plain.json", indent=2)
    whole = F.concat("instruction", "input", "output")
    got = files.read_json(spark, f"{path}-plain.json", indent=2).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(whole)).cast("long").alias("characters"), F.sum(F.octet_length(whole)).cast("long").alias("bytes"))
    plain = spark.read.text(f"{path}-plain.json").agg(F.count(F.when(F.col("value").rlike(r"\\\\u00[89a-f]|\\\\u0[1-9a-f]|\\\\u[1-9a-f]"), 1)).cast("int").alias("escapes"))
    return got.crossJoin(plain)  # one row each


@query("reflection_routes", f"WITH {_ROWS}, {_RAW} SELECT CASE WHEN raw LIKE 'x %' THEN 'success' ELSE 'failed' END AS status, conv_id, turn FROM raw")
def reflection_routes(spark, sf_dir):
    """Successes and failures appended to two folders, and read from both."""
    path = scratch(spark, "routes")
    I.write_routes(I.reflected(_raw(spark, sf_dir)), path, "instruction")
    kinds = {"success": f"{path}_instruction.jsonl", "failed": f"{path}_instruction_failed.jsonl"}
    parts = [files.read_json(spark, p, "conv_id long, turn int").select(F.lit(k).alias("status"), "conv_id", "turn") for k, p in kinds.items()]
    return parts[0].unionByName(parts[1])


@query("fetch_if_absent", "SELECT CAST(1 AS BIGINT) AS fetched, CAST(strlen(string_agg(text, chr(10) ORDER BY item_id)) AS BIGINT) AS bytes, sha256(string_agg(text, chr(10) ORDER BY item_id)) AS sha256 FROM benchmark")
def fetch_if_absent(spark, sf_dir):
    """A named dataset, asked for twice and fetched once."""
    text = "\n".join(r["text"] for r in table(spark, sf_dir, "benchmark").orderBy("item_id").collect())
    calls = []

    def fetch(place: str) -> bytes:
        calls.append(place)
        return text.encode()

    registry, folder = files.Registry({"items": "somewhere/items.txt"}, fetch), scratch(spark, "fetched")
    path = [registry.get(spark, "items", folder) for _ in range(2)][1]
    raw = files.read_text(spark, path)
    return raw.select(F.lit(len(calls)).cast("long").alias("fetched"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))


@query("dataset_config", "SELECT 'items' AS name, 'regex_bpe' AS tokenizer_type, 300 AS vocab_size, CAST(0.8 AS DOUBLE) AS train_split, 256 AS block_size, 'double_newline' AS document_splitter, 50 AS min_document_chars, 'unknown keys' AS refused, CAST(0.001 AS DOUBLE) AS learning_rate, 7 AS max_iters")
def dataset_config(spark, sf_dir):
    """A dataset's and a training run's YAML, with defaults and overrides; unknown keys are refused."""
    text = "name: items\nraw_file: a.txt\nprocessed_dir: out\ntokenizer_type: regex_bpe\nvocab_size: 300\ntrain_split: 0.8\ndocument_splitter: double_newline\n"
    got = datasets.load_config(text)
    try:
        datasets.load_config(text + "what: 1\n")
        refused = ""
    except TypeError as e:
        refused = str(e).partition(":")[0]
    train = datasets.load_train_config("config:\n  learning_rate: 0.001\n  max_iters: 5\n", max_iters=7, learning_rate=None)
    row = (got.name, got.tokenizer_type, got.vocab_size, got.train_split, got.block_size, got.document_splitter, got.min_document_chars, refused, train["learning_rate"], train["max_iters"])
    return spark.createDataFrame([row], "name string, tokenizer_type string, vocab_size int, train_split double, block_size int, document_splitter string, min_document_chars int, refused string, learning_rate double, max_iters int")


@query(
    "prepared_dataset",
    """WITH t AS (SELECT string_agg(text, chr(10) ORDER BY item_id) AS t FROM benchmark)
    SELECT CAST(length(t) AS BIGINT) AS total_characters, sha256(t) AS decoded_sha256, 'uint16' AS data_dtype, 300 AS vocab_size, true AS split_as_asked, true AS same_when_repeated FROM t""",
)
def prepared_dataset(spark, sf_dir):
    """Raw text to token files and their description, prepared twice; both splits read again and decoded."""
    folder = scratch(spark, "prepared")
    text = "\n".join(r["text"] for r in table(spark, sf_dir, "benchmark").orderBy("item_id").collect())
    files.write_bytes(spark, f"{folder}/raw.txt", text.encode())
    config = datasets.DatasetConfig("items", f"{folder}/raw.txt", f"{folder}/out", "regex_bpe", 300, 0.8)
    meta = datasets.prepare(spark, config, f"{folder}/tokenizers")
    again = datasets.prepare(spark, config, f"{folder}/tokenizers")
    bpe = P.Bpe.from_json(files.read_bytes(spark, meta["tokenizer_path"]).decode())
    parts = [datasets.load_split(spark, config.processed_dir, s).select(F.lit(k).alias("part"), "pos", "token_id") for k, s in enumerate(("train", "val"))]
    ids = parts[0].unionByName(parts[1]).groupBy().agg(F.sort_array(F.collect_list(F.struct("part", "pos", "token_id"))).alias("all"))
    decoded = ids.select(F.transform("all", lambda x: x["token_id"].cast("int")).alias("ids")).select(F.sha2(P.decode(F.col("ids"), bpe), 256).alias("decoded_sha256"))
    asked = meta["train_tokens"] == B.split_index(meta["total_tokens"], 0.8) and meta["train_tokens"] + meta["val_tokens"] == meta["total_tokens"]
    own = [F.lit(meta["total_characters"]).cast("long").alias("total_characters"), F.lit(meta["data_dtype"]).alias("data_dtype"), F.lit(meta["vocab_size"]).alias("vocab_size"), F.lit(asked).alias("split_as_asked"), F.lit(again == meta).alias("same_when_repeated")]
    return decoded.select(*own, "decoded_sha256")


@query("vocabulary_file", f"WITH {_VOCAB_3} SELECT * FROM vocab")
def vocabulary_file(spark, sf_dir):
    """A word vocabulary saved as JSON and loaded again."""
    folder = scratch(spark, "vocabulary")
    files.write_bytes(spark, f"{folder}/.made", b"")
    datasets.save_vocabulary(spark, V.build_vocabulary(table(spark, sf_dir, "documents"), min_frequency=3), f"{folder}/vocab.json")
    return datasets.load_vocabulary(spark, f"{folder}/vocab.json")


@query("loss_series", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'train', CAST(3.5 AS DOUBLE)), (1, 'train', 2.5), (0, 'val', 4.0), (1, 'val', 3.0), (2, 'val', 2.0)) t(iter, metric, value)")
def loss_series(spark, sf_dir):
    return datasets.loss_series({"train": [3.5, 2.5], "val": [4, 3, 2]}, spark)


@query("safetensors", "SELECT 'v' || vec_id AS name, '8,8' AS shape, round(list_sum(list_transform(embedding, lambda v, i: CAST(CAST(v AS FLOAT) AS DOUBLE) * i)), 5) + 0.0 AS checksum FROM embeddings")
def safetensors(spark, sf_dir):
    """Vectors as tensors of 8 x 8 in one weights file, read again."""
    path = scratch(spark, "weights") + ".safetensors"
    vectors = table(spark, sf_dir, "embeddings")
    weights.write_safetensors(vectors.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), F.array(F.lit(8), F.lit(8)).alias("shape"), F.transform("embedding", lambda v: v.cast("double")).alias("data")), path)
    total = F.aggregate(F.transform("data", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return weights.read_safetensors(spark, path).select("name", F.array_join(F.transform("shape", lambda v: v.cast("string")), ",").alias("shape"), (F.round(total, 5) + 0.0).alias("checksum"))


@query("token_types", "SELECT CAST(v AS BIGINT) AS vocab_size, CASE WHEN v <= 256 THEN 'uint8' WHEN v <= 65535 THEN 'uint16' ELSE 'uint32' END AS dtype FROM (VALUES (2), (256), (257), (65535), (65536), (100277)) t(v)")
def token_types(spark, sf_dir):
    return spark.createDataFrame([(v, B.token_type(v)) for v in (2, 256, 257, 65535, 65536, 100277)], "vocab_size long, dtype string")


@query("buffer_sizes", "SELECT CAST(a AS BIGINT) AS block_size, CAST(b AS BIGINT) AS batch_size, CAST(greatest(10000, least(10000000, 500 * b * (a + 1))) AS BIGINT) AS buffer FROM (VALUES (4, 2), (256, 8), (1024, 64)) t(a, b)")
def buffer_sizes(spark, sf_dir):
    return spark.createDataFrame([(a, b, B.LoaderConfig(a, b).buffer) for a, b in ((4, 2), (256, 8), (1024, 64))], "block_size long, batch_size long, buffer long")


@query("documents_whole", "SELECT doc_id, 0 AS doc_pos, text AS doc FROM documents WHERE length(text) >= 50")
def documents_whole(spark, sf_dir):
    """Without a splitter a text is one document."""
    return D.split_documents(table(spark, sf_dir, "documents"), "doc_id", method="none", min_chars=50)


@query("custom_chunks", r"WITH c AS (SELECT unnest(regexp_extract_all(text, '\p{Lu}\p{Ll}*|\p{Ll}+|\p{N}+|[^\p{Lu}\p{Ll}\p{N}]+')) AS chunk FROM documents) SELECT chunk, count(*) AS n FROM c GROUP BY chunk")
def custom_chunks(spark, sf_dir):
    """A pre-tokenizer of one's own."""
    pieces = chunks(F.col("text"), r"\p{Lu}\p{Ll}*|\p{Ll}+|\p{N}+|[^\p{Lu}\p{Ll}\p{N}]+")
    return table(spark, sf_dir, "documents").select(F.explode(pieces).alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


@query("hash_shuffle", "SELECT doc_id, md5('9:' || doc_id) AS shuffle_key FROM documents")
def hash_shuffle(spark, sf_dir):
    """A repeatable order for any number of documents."""
    return D.hash_shuffled(table(spark, sf_dir, "documents").select("doc_id"), 9, "doc_id")
