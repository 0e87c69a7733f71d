"""Document preparation: splitting, filtering, shuffling, joining, and corpus figures."""

from __future__ import annotations

import random
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.errors import TokenizerError
from lakeloom.functions.text import split_array

from .ranking import GROUPS, prefix_sum


def split_documents(df: DataFrame, key: str, text: str = "text", method: str = "none", pattern: str | None = None, min_chars: int = 50, seed: int | None = None, shuffle: bool = False) -> DataFrame:
    """(key, doc_pos, doc): the documents of each text in order, those of at least min_chars code points; shuffled if asked."""
    docs = df.select(key, F.posexplode(split_array(F.col(text), method, pattern)).alias("_at", "doc"))
    if min_chars > 0:
        docs = docs.where(F.length("doc") >= min_chars)
    ranked = docs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_at", "doc"))).alias("all")).select(key, F.posexplode(F.transform("all", lambda x: x["doc"])).alias("doc_pos", "doc"))
    return shuffled(ranked, key, seed) if shuffle else ranked


def split_in_order(df: DataFrame, key: str, order: str, text: str = "text", min_chars: int = 50, seed: int | None = None, shuffle: bool = False) -> DataFrame:
    """(key, doc_pos, doc): what split_documents() makes between blank lines of join_documents()'s text of each key, the rows in order of the number `order`, without that text: a blank line
    between two texts ends a document, whatever they end and begin with. Texts are shuffled once, by ranges of `order`, and once more if they are shuffled. A null key is a
    key like others; null texts have no documents."""
    pieces = F.filter(split_array(F.col(text), "double_newline"), lambda x: F.length(x) >= min_chars)
    rows = df.select(F.struct(key).alias("_key"), F.col(order).alias("_order"), pieces.alias("_docs")).where(F.size("_docs") > 0)
    ends = df.agg(F.min(order).cast("long"), F.max(order).cast("long")).first()
    width = max(4096, -(-(ends[1] - ends[0] + 1) // GROUPS)) if ends[0] is not None else 1
    rows = rows.withColumn("_part", F.coalesce(F.floor(F.col("_order") / width).cast("long"), F.lit(-(1 << 62)))).withColumn("_size", F.size("_docs").cast("long"))
    sums = rows.groupBy("_key", "_part").agg(F.sum("_size").alias("_sum"))
    before = sums.select("_key", "_part", F.coalesce(F.sum("_sum").over(W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_sum").over(W.partitionBy("_key")).alias("n"))
    inside = F.coalesce(F.sum("_size").over(W.partitionBy("_key", "_part").orderBy("_order", "_docs").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_inside", inside).join(before, ["_key", "_part"])
    docs = placed.select("_key", "n", (F.col("_before") + F.col("_inside")).alias("_at"), F.posexplode("_docs").alias("_own", "doc")).select("_key", "n", (F.col("_at") + F.col("_own")).cast("int").alias("doc_pos"), "doc")
    if shuffle:
        docs = _reordered(docs, before.select("n").distinct(), seed)
    return docs.select(F.col("_key")[key].alias(key), "doc_pos", "doc")


def permutation(n: int, seed: int | None) -> list[int]:
    """New order of n positions: entry k is the old position of the k-th element, by Mersenne Twister and Fisher-Yates."""
    return list(_permutation(n, seed))


def _permutation(n: int, seed: int | None) -> array:
    order = array("q", range(n))
    if n > 1:
        random.Random(seed).shuffle(order)
    return order


def shuffled(docs: DataFrame, key: str, seed: int | None) -> DataFrame:
    """(key, doc_pos, doc) in the exact seeded order, for any number of documents. The generator's numbers come one after the other, so a task makes the order of one number of
    documents, in 8 bytes for each; documents meet their new places by a shuffle."""
    keyed = docs.select(F.struct(key).alias("_key"), "doc_pos", "doc")
    sizes = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
    return _reordered(keyed.join(sizes, "_key"), sizes.select("n").distinct(), seed).select(F.col("_key")[key].alias(key), "doc_pos", "doc")


def _reordered(docs: DataFrame, sizes: DataFrame, seed: int | None) -> DataFrame:
    """docs, which has n, the number of documents of its key, and the position in them, with their new positions; sizes: the different n."""

    def run(batches):
        for b in batches:
            for n in b.column("n").to_pylist():
                old = np.frombuffer(_permutation(n, seed), np.int64)
                for k in range(0, n, 1 << 16):
                    part = old[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), n)), pa.array(part.astype(np.int32)), pa.array(np.arange(k, k + len(part), dtype=np.int32))], names=["n", "doc_pos", "new_pos"])

    parts = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = sizes.repartition(parts, "n").mapInArrow(run, "n long, doc_pos int, new_pos int")
    return docs.join(order.hint("shuffle_merge"), ["n", "doc_pos"]).drop("doc_pos").withColumnRenamed("new_pos", "doc_pos")


def hash_shuffled(docs: DataFrame, seed: int, *keys: str) -> DataFrame:
    """A repeatable order of any number of documents: by `shuffle_key`, the MD5 of seed and keys."""
    return docs.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])))


def join_documents(docs: DataFrame, key: str, separator: str = "\n\n") -> DataFrame:
    """(key, text): the documents of each key in order of doc_pos."""
    grouped = docs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("doc_pos", "doc"))).alias("all"))
    return grouped.select(key, F.array_join(F.transform("all", lambda x: x["doc"]), separator).alias("text"))


def corpus_summary(df: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """Documents, characters, and megabytes by characters (not bytes)."""
    chars = F.coalesce(F.sum(F.length(text)), F.lit(0))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_documents"), chars.cast("long").alias("total_characters"), F.concat(F.format_string("%.2f", chars / 1024 / 1024), F.lit(" MB")).alias("size_in_mb"))


def characters_per_token(tokens: DataFrame, *by: str) -> DataFrame:
    """From (text, n_tokens): characters by tokens; no tokens at all is an error."""
    total = F.sum("n_tokens")
    return tokens.groupBy(*by).agg(F.when(total == 0, F.raise_error("no tokens").cast("double")).otherwise(F.sum(F.length("text")).cast("double") / total).alias("characters_per_token"))


def check_tokens(n: int) -> int:
    if n <= 0:
        raise TokenizerError("the text gives no tokens")
    return n


__all__ = ["split_documents", "split_in_order", "permutation", "shuffled", "hash_shuffled", "join_documents", "corpus_summary", "characters_per_token", "check_tokens", "prefix_sum"]
