"""The core library's queries and their SQL, by name."""

from . import instruct_queries, model_queries, source_queries, stream_queries, text_queries, token_queries
from .base import QUERIES, oracles

__all__ = ["QUERIES", "oracles", "instruct_queries", "model_queries", "source_queries", "stream_queries", "text_queries", "token_queries"]
