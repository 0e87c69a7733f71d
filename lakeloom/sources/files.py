"""Text, JSON and JSON-lines sources and sinks; fetching of named files."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.text import universal_newlines

from .shared import folder

SAMPLE = "instruction string, input string, output string"
RESPONSE = SAMPLE + ", generated_response string"
#: What stands between two rows of an array.
ROW_END = ",\n"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that Spark reads is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files as UTF-8, with newlines made equal."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.input_file_name().alias("path"), universal_newlines(F.col("value")).alias("text"))


def read_json(spark: SparkSession, path: str, schema: str = SAMPLE, indent: int | None = None) -> DataFrame:
    """Rows of a JSON array, or of JSON lines for paths that end in .jsonl; blank lines are skipped, unreadable rows are errors. A task reads the whole of an array, unless `indent` says
    that write_json_array() wrote it with that indent: then its file is split where lines say that a row ends (no line within a row begins so), and all tasks read."""
    if indent is not None:
        return _laid_out(spark, path, schema, " " * indent)
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    return reader.json(path) if path.rstrip("/").endswith(".jsonl") else reader.option("multiLine", True).json(path)


def _laid_out(spark: SparkSession, path: str, schema: str, space: str) -> DataFrame:
    end = f"\n{space}}}"
    value = F.regexp_replace("value", r"\A\[\n?", "")
    rows = F.when(value.endswith("\n]"), F.concat(F.lit("["), value)).when(value == "]", F.lit("[]")).otherwise(F.concat(F.lit("["), value, F.lit(f"{end}]")))
    parsed = F.from_json(rows, f"array<struct<{_typed(schema)}>>", {"mode": "FAILFAST"})
    return spark.read.option("lineSep", f"{end},\n").text(path).select(F.inline(parsed))


def _typed(schema: str) -> str:
    return ", ".join("{}: {}".format(*c.split()) for c in schema.split(","))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, characters unescaped."""
    df.write.mode(mode).json(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_json_array(df: DataFrame, path: str, indent: int = 2, escaped: bool = False) -> None:
    """One JSON file that holds an array of all rows, indented, characters unescaped unless asked. Tasks format the rows and write them as parts; since a file has one writer,
    the parts are then laid end to end, file to file through a small buffer: rows never come to the driver. An existing file is replaced."""
    names, space = df.columns, " " * indent

    def run(batches):
        for b in batches:
            for k in range(0, len(b), 1024):
                rows = (json.dumps(r, indent=indent, ensure_ascii=escaped) for r in b.slice(k, 1024).to_pylist())
                text = ["\n".join(space + line for line in r.split("\n")) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(text, pa.string())], names=["value"])

    spark = df.sparkSession
    parts = folder(spark, "json-parts")
    df.select(*names).mapInArrow(run, "value string").write.option("lineSep", ROW_END).option("compression", "none").text(parts)
    _lay_end_to_end(spark, parts, path, b"[\n", len(ROW_END), b"\n]", b"[]")


def _lay_end_to_end(spark: SparkSession, parts: str, path: str, head: bytes, cut: int, tail: bytes, empty: bytes) -> None:
    """The files of a folder in order of their names as one file, without the last `cut` bytes, between head and tail (or `empty` where there is nothing). The folder goes."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    copied = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
    source, target = hadoop.fs.Path(parts), hadoop.fs.Path(path)
    fs = source.getFileSystem(conf)
    files = sorted(((len(f.getPath().getName()), f.getPath().getName(), f.getLen(), f.getPath()) for f in fs.listStatus(source) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda f: f[:2])
    out = target.getFileSystem(conf).create(target, True)
    try:
        out.write(bytearray(head if files else empty))
        for k, (_, _, size, at) in enumerate(files):
            into = fs.open(at)
            try:
                copied.copyLarge(into, out, 0, size - (cut if k == len(files) - 1 else 0))
            finally:
                into.close()
        out.write(bytearray(tail if files else b""))
    finally:
        out.close()
    fs.delete(source, True)


def rewrite_unescaped(spark: SparkSession, source: str, target: str, schema: str = SAMPLE, indent: int | None = None) -> None:
    """A JSON array or JSON lines with escapes rewritten as an array in plain UTF-8; indent as in read_json()."""
    write_json_array(read_json(spark, source, schema, indent), target)


class Registry:
    """Places of named datasets; the caller gives names, places and the function that fetches bytes."""

    def __init__(self, places: dict[str, str], fetch: Callable[[str], bytes]):
        self.places, self.fetch = dict(places), fetch

    def get(self, spark: SparkSession, name: str, folder: str) -> str:
        """The path of a named file in folder; fetched only if it is absent."""
        if name not in self.places:
            raise ValueError(f"unknown dataset: {name}")
        path = f"{folder.rstrip('/')}/{self.places[name].rsplit('/', 1)[-1]}"
        if not exists(spark, path):
            write_bytes(spark, path, self.fetch(self.places[name]))
        return path


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        for k in range(0, len(data), 1 << 20):
            out.write(bytearray(data[k : k + (1 << 20)]))
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])
