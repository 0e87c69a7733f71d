"""Word vocabularies: building, encoding and decoding as plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.errors import TokenizerError
from lakeloom.functions.words import END_OF_TEXT, UNKNOWN, join_words, word_tokens

from .lookup import look_up_arrays
from .ranking import rank_strings


def build_vocabulary(df: DataFrame, text: str = "text", min_frequency: int = 1, specials: tuple[str, ...] = (UNKNOWN, END_OF_TEXT)) -> DataFrame:
    """(token, id): tokens that occur at least min_frequency times by code points, then the specials.

    A special that is also a token has the later id only; the earlier one stays unused.
    """
    counts = df.select(F.explode(word_tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_frequency)
    ranked = rank_strings(counts.select("token"), "token", "id")
    size = counts.agg(F.count(F.lit(1)).alias("size"))
    given = df.sparkSession.createDataFrame(list(enumerate(specials)), "ord long, token string") if specials else None
    if given is None:
        return ranked
    own = F.broadcast(given).crossJoin(size).select("token", (F.col("size") + F.col("ord")).alias("id"))
    return ranked.join(F.broadcast(given.select("token")), "token", "left_anti").unionByName(own)


def check_vocabulary(vocab: DataFrame, unknown: str = UNKNOWN) -> int:
    """The id of the unknown token; an empty vocabulary or one without it is an error."""
    row = vocab.where(F.col("token") == unknown).select("id").first()
    if row is None:
        raise TokenizerError(f"the vocabulary is empty or has no {unknown}")
    return int(row["id"])


def encode_documents(df: DataFrame, vocab: DataFrame, keys: list[str], text: str = "text", unknown: str = UNKNOWN) -> DataFrame:
    """(keys, ids): the ids of each text's words in order; words that the vocabulary lacks get the unknown id."""
    unknown_id = check_vocabulary(vocab, unknown)
    found = look_up_arrays(df.select(*keys, text), word_tokens, F.octet_length(text), vocab.select("token", F.col("id").cast("long")), "ids")
    return found.select(*keys, F.transform("ids", lambda i: F.coalesce(i, F.lit(unknown_id).cast("long"))).alias("ids"))


def encode_words(df: DataFrame, vocab: DataFrame, keys: list[str], text: str = "text", unknown: str = UNKNOWN) -> DataFrame:
    """(keys, pos, token_id): encode_documents() in long form."""
    return encode_documents(df, vocab, keys, text, unknown).select(*keys, F.posexplode("ids").alias("_pos", "token_id")).select(*keys, F.col("_pos").cast("long").alias("pos"), "token_id")


def _decoded(ids: DataFrame, vocab: DataFrame, keys: list[str]) -> DataFrame:
    names = look_up_arrays(ids.select(*keys, "ids"), lambda c: c, F.size("ids") * 8, vocab.select(F.col("id").cast("long"), "token"), "tokens", "unknown token id")
    return names.select(*keys, join_words(F.col("tokens")).alias("text"))


def decode_documents(ids: DataFrame, vocab: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text) from (keys, ids); rows without ids have no text, those with the same keys have one, place by place. An unknown id is an error."""
    some = ids.select(*keys, "ids").where(F.size("ids") > 0)
    if some.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        return _decoded(some, vocab, keys)
    return decode_words(some.select(*keys, F.posexplode("ids").alias("pos", "token_id")), vocab, keys)


def decode_words(ids: DataFrame, vocab: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text) from (keys, pos, token_id); an unknown id is an error."""
    grouped = ids.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", F.col("token_id").cast("long").alias("id")))).alias("_ids"))
    return _decoded(grouped.select(*keys, F.transform("_ids", lambda i: i["id"]).alias("ids")), vocab, keys)
