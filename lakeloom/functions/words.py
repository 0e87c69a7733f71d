"""Word tokens and decoding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word with inner apostrophes, or one other visible character.
WORD_PATTERN = r"(?U)\w+(?:'\w+)*|[^\w\s]"
# Characters before which decoding puts no blank, and the default special tokens.
PUNCTUATION = [".", ",", "!", "?", ";", ":", "-", "(", ")", "[", "]", "{", "}", "\\", '"']
UNKNOWN, END_OF_TEXT = "<|UNK|>", "<|endoftext|>"


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def join_words(tokens: Column) -> Column:
    """Tokens with a blank before each that is not punctuation; without blanks at the ends."""
    marks = F.array(*[F.lit(p) for p in PUNCTUATION])
    return F.trim(F.array_join(F.transform(tokens, lambda t: F.when(F.array_contains(marks, t), t).otherwise(F.concat(F.lit(" "), t))), ""))
