"""Queries on documents and word vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions.text import GPT2_PATTERN, GPT4_PATTERN, chunks, split_array, strip
from lakeloom.functions.words import word_tokens
from lakeloom.operators import documents as D
from lakeloom.operators import wordvocab as V
from lakeloom.sources.shared import keep
from lakeloom.sources.tables import table, texts

from .base import query

_WORDS = r"regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+(?:''[\p{L}\p{M}\p{N}_]+)*|[^\p{L}\p{M}\p{N}_\s]')"


@query("word_vocab", f"WITH v AS (SELECT DISTINCT unnest({_WORDS}) AS token FROM documents) SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS BIGINT) AS id FROM v")
def word_vocab(spark, sf_dir):
    return V.build_vocabulary(texts(spark, sf_dir), specials=())


_VOCAB_3 = f"""
    t AS (SELECT unnest({_WORDS}) AS token FROM documents),
    v AS (SELECT token FROM t GROUP BY token HAVING count(*) >= 3),
    vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS BIGINT) AS id FROM v
        UNION ALL SELECT '<|UNK|>', count(*) FROM v UNION ALL SELECT '<|endoftext|>', count(*) + 1 FROM v)"""


@query("word_vocab_min_frequency", f"WITH {_VOCAB_3} SELECT * FROM vocab")
def word_vocab_min_frequency(spark, sf_dir):
    return V.build_vocabulary(texts(spark, sf_dir), min_frequency=3)


@query(
    "word_token_counts",
    f"SELECT lang, CAST(sum(len({_WORDS})) AS BIGINT) AS n_tokens, CAST(max(len({_WORDS})) AS BIGINT) AS most FROM documents GROUP BY lang",
)
def word_token_counts(spark, sf_dir):
    n = F.size(word_tokens(F.col("text")))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(n).cast("long").alias("n_tokens"), F.max(n).cast("long").alias("most"))


@query(
    "word_encode",
    f"""WITH {_VOCAB_3}, tok AS (SELECT doc_id, unnest({_WORDS}) AS token, unnest(generate_series(0, len({_WORDS}) - 1)) AS pos FROM documents)
    SELECT doc_id, pos, coalesce(id, (SELECT id FROM vocab WHERE token = '<|UNK|>')) AS token_id FROM tok LEFT JOIN vocab USING (token)""",
)
def word_encode(spark, sf_dir):
    docs = texts(spark, sf_dir)
    vocab = keep(V.build_vocabulary(docs, min_frequency=3), "vocabulary")
    return V.encode_words(docs, vocab, ["doc_id"])


@query(
    "word_decode",
    f"""WITH tok AS (SELECT doc_id, unnest({_WORDS}) AS token, unnest(generate_series(0, len({_WORDS}) - 1)) AS pos FROM documents)
    SELECT doc_id, trim(string_agg(CASE WHEN token IN ('.', ',', '!', '?', ';', ':', '-', '(', ')', '[', ']', '{{', '}}', '\\', '"') THEN token ELSE ' ' || token END, '' ORDER BY pos)) AS text
    FROM tok GROUP BY doc_id""",
)
def word_decode(spark, sf_dir):
    docs = texts(spark, sf_dir)
    vocab = keep(V.build_vocabulary(docs), "vocabulary")
    return V.decode_documents(keep(V.encode_documents(docs, vocab, ["doc_id"]), "word-ids", codec="zstd"), vocab, ["doc_id"])


@query(
    "corpus_summary",
    """SELECT lang, source, count(*) AS n_documents, CAST(sum(length(text)) AS BIGINT) AS total_characters, printf('%.2f MB', sum(length(text)) / 1024.0 / 1024.0) AS size_in_mb
    FROM documents GROUP BY lang, source""",
)
def corpus_summary(spark, sf_dir):
    return D.corpus_summary(table(spark, sf_dir, "documents"), "lang", "source")


def _framed(spark, sf_dir):
    """Documents with a blank before and a blank and a newline behind."""
    return table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("doc_pos"), F.concat(F.lit(" "), F.col("text"), F.lit(" \n")).alias("doc"))


_CORPORA = "corpora AS (SELECT source, string_agg(' ' || text || ' ' || chr(10), chr(10) || chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY source)"
_PIECES = r"list_filter(list_transform(regexp_split_to_array(text, '\n{2,}'), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '')"


@query(
    "documents_split",
    f"""WITH {_CORPORA}, p AS (SELECT source, unnest({_PIECES}) AS doc, unnest(generate_series(0, len({_PIECES}) - 1)) AS seq FROM corpora),
    k AS (SELECT source, doc, seq FROM p WHERE length(doc) >= 50)
    SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY seq) - 1 AS INTEGER) AS doc_pos, doc FROM k""",
)
def documents_split(spark, sf_dir):
    return D.split_in_order(_framed(spark, sf_dir), "source", "doc_pos", "doc", min_chars=50)


@query(
    "documents_split_regex",
    r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+\s+'), lambda x: trim(x, chr(10) || ' ')), lambda x: x <> '') AS ps FROM documents)
    SELECT doc_id, CAST(len(ps) AS BIGINT) AS n_pieces, CAST(list_max(list_transform(ps, lambda x: length(x))) AS BIGINT) AS longest FROM p""",
)
def documents_split_regex(spark, sf_dir):
    pieces = split_array(F.col("text"), "regex", r"[.!?]+\s+")
    got = table(spark, sf_dir, "documents").select("doc_id", pieces.alias("ps"))
    return got.select("doc_id", F.size("ps").cast("long").alias("n_pieces"), F.array_max(F.transform("ps", F.length)).cast("long").alias("longest"))


@query("documents_joined", f"WITH {_CORPORA} SELECT source, text FROM corpora")
def documents_joined(spark, sf_dir):
    """One text for each source: its documents between blank lines."""
    return D.join_documents(_framed(spark, sf_dir), "source")


@query(
    "documents_min_length",
    "SELECT lang, count(*) AS n_kept, CAST(min(length(trim(text, chr(10) || ' '))) AS BIGINT) AS shortest FROM documents WHERE length(trim(text, chr(10) || ' ')) >= 200 GROUP BY lang",
)
def documents_min_length(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", F.length(strip(F.col("text"))).alias("n")).where("n >= 200")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_kept"), F.min("n").cast("long").alias("shortest"))


@query("documents_shuffled")
def documents_shuffled(spark, sf_dir):
    return D.split_in_order(_framed(spark, sf_dir), "source", "doc_pos", "doc", shuffle=True, seed=42)


@query(
    "characters_per_token",
    f"SELECT lang, round(sum(length(text)) / sum(len({_WORDS})), 8) AS characters_per_token FROM documents GROUP BY lang",
)
def characters_per_token(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "text", F.size(word_tokens(F.col("text"))).alias("n_tokens"))
    return D.characters_per_token(docs, "lang").select("lang", F.round("characters_per_token", 8).alias("characters_per_token"))


def _chunk_query(spark, sf_dir, pattern):
    docs = texts(spark, sf_dir).select(F.explode(chunks(F.col("text"), pattern)).alias("chunk"))
    return docs.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


#: RE2 has no lookahead: a mark before the last of several blanks that precede a non-blank splits the run.
_MARKED = r"regexp_replace(text, '(\s)([^\S\r\n])(\S)', '\1' || chr(1) || '\2\3', 'g')"
_GPT4 = r"regexp_extract_all(" + _MARKED + r", '''(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}\x01]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}\x01]+[\r\n]*|\s*[\r\n]|\s+')"
_GPT2 = r"regexp_extract_all(" + r"regexp_replace(text, '(\s)(\s)(\S)', '\1' || chr(1) || '\2\3', 'g')" + r", '''(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x01]+|\s+')"


@query("gpt4_chunks", f"WITH c AS (SELECT unnest({_GPT4}) AS chunk FROM documents) SELECT chunk, count(*) AS n FROM c GROUP BY chunk")
def gpt4_chunks(spark, sf_dir):
    return _chunk_query(spark, sf_dir, GPT4_PATTERN)


@query("gpt2_chunks", f"WITH c AS (SELECT unnest({_GPT2}) AS chunk FROM documents) SELECT chunk, count(*) AS n FROM c GROUP BY chunk")
def gpt2_chunks(spark, sf_dir):
    return _chunk_query(spark, sf_dir, GPT2_PATTERN)
