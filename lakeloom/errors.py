"""Errors of the library."""


class LakeloomError(Exception):
    """Base of the library's own errors."""


class TokenizerError(LakeloomError):
    """A tokenizer is untrained, incomplete, or met an unknown id."""


class DataLoaderError(LakeloomError):
    """Token files or batches do not fit together."""


class EmbeddingsError(LakeloomError):
    """A sequence is longer than the context."""
