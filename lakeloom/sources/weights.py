"""Weights in the safetensors format: a length, a JSON header with each tensor's type, shape and place, and the bytes."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

# Names of types in the header.
TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4"}
SCHEMA = "name string, shape array<int>, data array<double>"


def header(spark: SparkSession, path: str) -> tuple[dict, int]:
    """The header and the place where the bytes begin; only these bytes are read."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        n = int.from_bytes(bytes(stream.readNBytes(8)), "little")
        return json.loads(bytes(stream.readNBytes(n))), 8 + n
    finally:
        stream.close()


def read_safetensors(spark: SparkSession, path: str) -> DataFrame:
    """(name, shape, data) of a file, a row for each tensor. The file is one row of Spark's binary source, so it must fit in a task."""
    head, start = header(spark, path)
    head.pop("__metadata__", None)

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                raw = memoryview(content.as_buffer())
                for name, t in head.items():
                    a, z = (start + x for x in t["data_offsets"])
                    values = np.frombuffer(raw[a:z], TYPES[t["dtype"]]).astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([t["shape"]], pa.list_(pa.int32())), pa.array([values], pa.list_(pa.float64()))], names=["name", "shape", "data"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


def write_safetensors(weights: DataFrame, path: str, dtype: str = "F32") -> None:
    """One file of a weights table, in order of names. The driver holds the header and one partition of tensors at a time."""
    spark, size = weights.sparkSession, np.dtype(TYPES[dtype]).itemsize
    head, at = {}, 0
    for r in weights.select("name", "shape", F.size("data").alias("n")).orderBy("name").collect():
        head[r["name"]] = {"dtype": dtype, "shape": list(r["shape"]), "data_offsets": [at, at + r["n"] * size]}
        at += r["n"] * size
    text = json.dumps(head).encode()

    def pack(batches):
        for b in batches:
            for x in b.column("data"):
                yield pa.RecordBatch.from_arrays([pa.array([x.values.to_numpy(zero_copy_only=False).astype(TYPES[dtype]).tobytes()], pa.binary())], names=["data"])

    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(len(text).to_bytes(8, "little") + text))
        for row in weights.orderBy("name").select("data").mapInArrow(pack, "data binary").toLocalIterator():
            out.write(bytearray(row["data"]))
    finally:
        out.close()


def cached(spark: SparkSession, registry: files.Registry, name: str, folder: str) -> DataFrame:
    """A published weights file, fetched into folder unless it is there."""
    return read_safetensors(spark, registry.get(spark, name, folder))
