"""Errors of configuration, which are raised, and of rows, which are reported in an error column."""

from __future__ import annotations


class LoomError(Exception):
    """Base of all errors raised here."""


class ConfigError(LoomError, ValueError):
    """A parameter is out of its domain."""


class InvalidInput(LoomError, ValueError):
    """A document cannot be processed."""


class ModelMismatch(LoomError):
    def __init__(self, a: str, b: str):
        super().__init__(f"model mismatch: {a} vs {b}")


class DimensionMismatch(LoomError):
    def __init__(self, a: int, b: int):
        super().__init__(f"dimension mismatch: {a} vs {b}")


class SchemaMismatch(LoomError):
    def __init__(self, expected: int, actual: int):
        super().__init__(f"schema mismatch: expected {expected}, got {actual}")


class EmptyEmbedding(LoomError):
    def __init__(self) -> None:
        super().__init__("empty embedding")


class TokenizerError(LoomError):
    """A tokenizer is missing or fails."""


class OnnxError(LoomError):
    """Local inference fails."""


class HttpError(LoomError):
    """A provider answers with an error that a retry does not mend."""


class FeatureDisabled(LoomError):
    """Something that is not installed here is asked for."""
