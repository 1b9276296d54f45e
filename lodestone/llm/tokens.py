"""Token ids of texts by a public byte-level BPE vocabulary; chats, packing and mixing all count the same tokens."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def ranks(path: str = TOKENIZER) -> bytes:
    """The vocabulary file, read where the job is planned; tasks get its bytes, so that executors need no file."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def encoding(vocabulary: bytes) -> tiktoken.Encoding:
    made = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=made, special_tokens={})


def end_of_text(vocabulary: bytes) -> int:
    """The first id after those of the vocabulary, which ends a document."""
    return encoding(vocabulary).max_token_value + 1


def encode(vocabulary: bytes, text: str) -> np.ndarray:
    """The ids of a text, without reserved ones."""
    return encoding(vocabulary).encode_to_numpy(text)


def texts_of(column: pa.Array) -> list[str]:
    """The texts of a binary column."""
    return [str(x.as_buffer(), "utf-8", "replace") for x in column]
