"""Text expressions: stripping, splitting into documents, pre-tokenizers and byte strings.

Java's character classes are Unicode only after (?U), so every pattern starts with it. Python's strip() also takes
U+001C to U+001F, which Java's blanks do not hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The two published pre-tokenizer patterns.
GPT2_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GPT4_PATTERN = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"

_BLANK = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Without leading and trailing blanks, as Python's str.strip()."""
    return F.regexp_replace(text, F.lit(rf"(?U)^{_BLANK}+|{_BLANK}+\z"), F.lit(""))


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"\r\n?"), F.lit("\n"))


def check_pattern(pattern: str) -> str:
    """A pattern without capturing groups (their text would leak into the pieces)."""
    if not pattern:
        raise ValueError("a pattern is needed")
    if re.search(r"(?<!\\)(?:\\\\)*\((?!\?)", re.sub(r"\[(?:\\.|[^\]\\])*\]", "", pattern)) or re.search(r"\(\?P?<(?![=!])", pattern):
        raise ValueError("the pattern must not have capturing groups; use (?:...)")
    return pattern


def split_array(text: Column, method: str = "none", pattern: str | None = None) -> Column:
    """The documents of a text, in order: the text itself ("none"), or its non-empty stripped pieces between blank lines
    ("double_newline") or matches of a pattern ("regex")."""
    if method == "none":
        return F.array(text)
    if method == "double_newline":
        pattern = r"\n{2,}"
    elif method == "regex":
        if pattern is None:
            raise ValueError("the regex splitter needs a pattern")
        pattern = "(?U)" + check_pattern(pattern)
    else:
        raise ValueError(f"unknown splitter: {method}")
    return F.filter(F.transform(F.split(text, F.lit(pattern), F.lit(-1)), strip), lambda x: x != "")


def chunks(text: Column, pattern: str = GPT4_PATTERN) -> Column:
    """Pre-token chunks in order; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit("(?U)" + check_pattern(pattern)), F.lit(0))


def byte_string(text: Column) -> Column:
    """One character for each UTF-8 byte, with the byte as its code point."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def fast_byte_ids(text: Column) -> Column:
    """byte_ids() by Arrow batches, without a string for each byte: for whole corpora."""
    return F.arrow_udf(_bytes_of, "array<int>")(F.coalesce(text, F.lit("")))


#: Bytes of texts that a worker turns into tokens, or of tokens that it turns into texts, before it hands them on.
PIECE = 1 << 20


def pieces_of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Batches of texts, binaries or lists of numbers in pieces of about PIECE bytes (a value may be longer), so what a worker makes of a batch does not grow with it; an empty batch is one piece."""
    for c in columns:
        listed = pa.types.is_list(c.type)
        sizes = pc.fill_null(pc.list_value_length(c) if listed else pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes.astype(np.int64)) * (c.type.value_type.bit_width // 8 if listed else 1), 0
        while True:
            to = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + PIECE, "right")))
            yield c.slice(at, to - at)
            at = to
            if at >= len(c):
                break


def _bytes_of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for c in pieces_of(columns):
        raw = c.cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        yield pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(data.astype(np.int32)))


def byte_ids(text: Column) -> Column:
    """UTF-8 bytes as an array of integers, from native expressions."""
    chars = F.filter(F.split(byte_string(text), F.lit(""), F.lit(-1)), lambda c: c != "")
    return F.transform(chars, F.ascii)
