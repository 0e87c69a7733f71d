"""Token datasets: configuration, preparation, token files and their description."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.errors import DataLoaderError
from lakeloom.operators import blocks, bpe, documents

from . import files

META = (
    "dataset_name string, raw_file string, processed_dir string, total_characters long, vocab_size long, tokenizer_type string, tokenizer_path string, total_tokens long, characters_per_token double, train_tokens long, val_tokens long, "
    "train_split double, block_size long, data_dtype string, num_documents long, document_splitter string, document_regex string, shuffle_documents boolean, shuffle_seed long, min_document_chars long, join_separator string"
)


@dataclass(frozen=True)
class DatasetConfig:
    name: str
    raw_file: str
    processed_dir: str
    tokenizer_type: str
    vocab_size: int
    train_split: float = 0.9
    block_size: int = 256
    special_tokens: dict[str, int] | None = None
    document_splitter: str = "none"
    document_regex: str | None = None
    shuffle_documents: bool = False
    shuffle_seed: int | None = 42
    min_document_chars: int = 50
    join_separator: str = "\n\n"


def _yaml(text: str) -> dict:
    import yaml

    return yaml.safe_load(text) or {}


def load_config(text: str) -> DatasetConfig:
    """A configuration from YAML text; unknown keys are an error."""
    got = _yaml(text)
    unknown = set(got) - {f.name for f in fields(DatasetConfig)}
    if unknown:
        raise TypeError(f"unknown keys: {sorted(unknown)}")
    return DatasetConfig(**got)


def load_train_config(text: str, **overrides) -> dict:
    """Training options from YAML, flat or under config:; overrides count only if they are truthy."""
    got = _yaml(text)
    got = dict(got.get("config", got))
    return got | {k: v for k, v in overrides.items() if v}


def tokenizer_path(config: DatasetConfig, folder: str) -> str:
    """A path that changes with what the tokenizer depends on."""
    import hashlib

    key = hashlib.sha256(json.dumps([config.raw_file, config.vocab_size, config.tokenizer_type, config.special_tokens], sort_keys=True).encode()).hexdigest()[:12]
    return f"{folder.rstrip('/')}/{config.name}_{config.tokenizer_type}_{key}.json"


def prepare(spark: SparkSession, config: DatasetConfig, tokenizer_dir: str) -> dict:
    """Raw text to token files and meta.json. Does nothing if both token files are there; a saved tokenizer is loaded, not trained."""
    out = config.processed_dir.rstrip("/")
    raw = files.read_text(spark, config.raw_file).select(F.lit(0).cast("long").alias("src_id"), "text")
    path = tokenizer_path(config, tokenizer_dir)
    tokenizer = bpe.make_tokenizer(config.tokenizer_type)
    if files.exists(spark, path):
        tokenizer = bpe.Bpe.from_json(files.read_bytes(spark, path).decode())
    else:
        tokenizer = bpe.train(raw, "src_id", config.vocab_size, specials=config.special_tokens)
        files.write_bytes(spark, path, tokenizer.to_json().encode())
    if files.exists(spark, f"{out}/train.bin") and files.exists(spark, f"{out}/val.bin"):
        return read_meta(spark, out)
    text, n_docs = raw, 1
    if config.document_splitter != "none":
        docs = documents.split_documents(raw, "src_id", "text", config.document_splitter, config.document_regex, config.min_document_chars, config.shuffle_seed, config.shuffle_documents)
        text, n_docs = documents.join_documents(docs, "src_id", config.join_separator), docs.count()
    coded = text.select("src_id", F.length("text").cast("long").alias("chars"), bpe.encode(F.col("text"), tokenizer).alias("token_ids")).cache()
    try:
        sizes = coded.agg(F.sum("chars").alias("chars"), F.sum(F.size("token_ids")).alias("n")).first()
        n = documents.check_tokens(int(sizes["n"] or 0))
        cut = blocks.split_index(n, config.train_split)
        top = int(coded.select(F.max(F.array_max("token_ids"))).first()[0])
        dtype = blocks.token_type(max(len(tokenizer.vocabulary), top + 1))
        parts = blocks.split_tokens(blocks.long_tokens(blocks.positions(coded, "src_id")), n, config.train_split)
        for split in ("train", "val"):
            write_tokens(parts.where(F.col("split") == split), f"{out}/{split}.bin", dtype)
    finally:
        coded.unpersist()
    meta = {
        "dataset_name": config.name, "raw_file": config.raw_file, "processed_dir": config.processed_dir, "total_characters": int(sizes["chars"]), "vocab_size": len(tokenizer.vocabulary), "tokenizer_type": config.tokenizer_type, "tokenizer_path": path,
        "total_tokens": n, "characters_per_token": int(sizes["chars"]) / n, "train_tokens": cut, "val_tokens": n - cut, "train_split": config.train_split, "block_size": config.block_size, "data_dtype": dtype, "num_documents": n_docs,
        "document_splitter": config.document_splitter, "document_regex": config.document_regex, "shuffle_documents": config.shuffle_documents, "shuffle_seed": config.shuffle_seed, "min_document_chars": config.min_document_chars, "join_separator": config.join_separator,
    }
    files.write_bytes(spark, f"{out}/meta.json", json.dumps(meta, indent=2).encode())
    return meta


def write_tokens(tokens: DataFrame, path: str, dtype: str) -> None:
    """(pos, token_id) as one headerless little-endian array. Rows are brought into order partition by partition, so the driver holds
    one partition at a time; large corpora stay in Parquet (write_token_table)."""
    spark = tokens.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    kind = np.dtype(dtype).newbyteorder("<")

    def pack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("pos").slice(0, 1), pa.array([b.column("token_id").to_numpy().astype(kind).tobytes()], pa.binary())], names=["pos", "data"])

    try:
        ordered = tokens.select(F.col("pos").cast("long").alias("pos"), F.col("token_id").cast("long").alias("token_id")).orderBy("pos")
        for row in ordered.mapInArrow(pack, "pos long, data binary").toLocalIterator():
            out.write(bytearray(row["data"]))
    finally:
        out.close()


def write_token_table(placed: DataFrame, path: str) -> None:
    """Documents' token ids with their start positions, as Parquet."""
    placed.write.parquet(path)


def read_tokens(spark: SparkSession, path: str, dtype: str) -> DataFrame:
    """(pos, token_id) of a token file."""

    def run(batches):
        for b in batches:
            for data in b.column("content").to_pylist():
                if len(data) % np.dtype(dtype).itemsize:
                    raise DataLoaderError(f"the file's size is no multiple of {dtype}")
                ids = np.frombuffer(data, np.dtype(dtype).newbyteorder("<")).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ids))), pa.array(ids)], names=["pos", "token_id"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "pos long, token_id long")


def read_meta(spark: SparkSession, folder: str) -> dict:
    path = f"{folder.rstrip('/')}/meta.json"
    if not files.exists(spark, path):
        raise FileNotFoundError(path)
    return json.loads(files.read_bytes(spark, path))


def load_split(spark: SparkSession, folder: str, split: str, dtype: str | None = None) -> DataFrame:
    """(pos, token_id) of a split, in the type that its description names."""
    meta = read_meta(spark, folder)
    return read_tokens(spark, f"{folder.rstrip('/')}/{split}.bin", dtype or meta.get("data_dtype") or blocks.token_type(meta["vocab_size"]))


def save_vocabulary(spark: SparkSession, vocab: DataFrame, path: str) -> None:
    """{token: id} as JSON; the parent folder must be there. A vocabulary is small enough for one file."""
    if not files.exists(spark, path.rsplit("/", 1)[0]):
        raise FileNotFoundError(path.rsplit("/", 1)[0])
    rows = vocab.orderBy("id").collect()
    files.write_bytes(spark, path, json.dumps({r["token"]: r["id"] for r in rows}, ensure_ascii=False, indent=2).encode())


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    if not files.exists(spark, path):
        raise FileNotFoundError(path)
    return spark.createDataFrame(list(json.loads(files.read_bytes(spark, path)).items()), "token string, id long")


def loss_series(history: dict[str, list[float]], spark: SparkSession) -> DataFrame:
    """(iter, metric, value): what a plot of the losses shows."""
    return spark.createDataFrame([(i, k, float(v)) for k, vs in history.items() for i, v in enumerate(vs)], "iter long, metric string, value double")
