"""Places of the public vocabularies; every operator takes them as parameters, these are the queries' values."""

from __future__ import annotations


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def unigram_vocabulary() -> str:
    return _path("piece_bpe_32k.model")


def bpe_json() -> str:
    return _path("byte_bpe_50k.json")


def bpe_ranks() -> str:
    return _path("byte_bpe_50k.tiktoken")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN
