"""Byte-level BPE from a vocabulary file: words of a text, and ids of a word."""

from __future__ import annotations

import base64

#: A vocabulary of lines "base64 rank", and the words that it was made for.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The alternatives that match most often stand first; none that is moved can match where another does.
PATTERN = r" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def splitter(pattern: str = PATTERN):
    """text -> its words; joined again they are the text."""
    import regex

    return regex.compile(pattern).findall


def encoder(ranks: dict[bytes, int]):
    """bytes of a word -> its ids"""
    import tiktoken

    # a word is one piece already: it needs no second splitting
    return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
