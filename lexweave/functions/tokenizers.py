"""Tokenizers by name, and token columns made with them.

Vocabulary files are read from a folder that every executor can see (a parameter);
none is fetched.  A null text has no tokens and stays null when it is truncated.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

FOLDER = os.environ.get("LEXWEAVE_TOKENIZERS", "/opt/tokenizers")


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


class Words:
    """White-space words as tokens; needs no file. Ids are places in the words seen so far."""

    def __init__(self, path: str | None = None) -> None:
        self.words: list[str] = []
        self.places: dict[str, int] = {}

    def encode(self, text: str) -> list[int]:
        out = []
        for w in text.split():
            if w not in self.places:
                self.places[w] = len(self.words)
                self.words.append(w)
            out.append(self.places[w])
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.words[i] for i in ids)


class Ranks:
    """Byte-level BPE by ranks."""

    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.inner = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self.inner.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return self.inner.decode(ids)


class Described:
    """A tokenizer described by a JSON file."""

    def __init__(self, path: str) -> None:
        import tokenizers

        self.inner = tokenizers.Tokenizer.from_file(path)
        self.inner.encode_special_tokens = True
        if self.inner.decoder is None:
            self.inner.decoder = tokenizers.decoders.BPEDecoder(suffix="</w>")

    def encode(self, text: str) -> list[int]:
        return self.inner.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self.inner.decode(ids)


class Pieces:
    """A piece model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.inner = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, text: str) -> list[int]:
        return self.inner.encode(text)

    def decode(self, ids: list[int]) -> str:
        return self.inner.decode(ids)


KINDS: dict[str, tuple[Callable[..., Tokenizer], str | None]] = {
    "words": (Words, None),
    "byte_bpe": (Ranks, "byte_bpe_50k.tiktoken"),
    "byte_bpe_multi": (Ranks, "byte_bpe_multi_50k.tiktoken"),
    "word_bpe": (Described, "word_bpe_49k.json"),
    "piece_bpe": (Pieces, "piece_bpe_32k.model"),
}
#: The kind that stands in for the tokenizer of each provider.
OF_PROVIDER = dict.fromkeys(["openai", "azure_openai", "bedrock", "deep_infra", "open_router", "vertex", "anthropic", "cohere", "ai21"], "byte_bpe") | dict.fromkeys(["hf_local", "hf_remote", "inference_server"], "piece_bpe")
_OPEN: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(kind: str, folder: str = FOLDER) -> Tokenizer:
    """One instance per process."""
    if (kind, folder) not in _OPEN:
        make, file = KINDS[kind]
        _OPEN[kind, folder] = make(os.path.join(folder, file)) if file else make()
    return _OPEN[kind, folder]


def token_length(text: Column, kind: str = "byte_bpe", folder: str = FOLDER) -> Column:
    @F.pandas_udf(IntegerType())
    def count(s: pd.Series) -> pd.Series:
        t = tokenizer(kind, folder)
        return s.map(lambda x: len(t.encode(x)) if x is not None else None).astype("Int32")

    return count(text)


def truncate_tokens(text: Column, most: int, kind: str = "byte_bpe", folder: str = FOLDER) -> Column:
    """The text of its first ``most`` tokens; shorter texts are left as they are."""

    @F.pandas_udf(StringType())
    def cut(s: pd.Series) -> pd.Series:
        t = tokenizer(kind, folder)

        def one(x: str | None) -> str | None:
            if x is None:
                return None
            ids = t.encode(x)
            return x if len(ids) <= most else t.decode(ids[:most])

        return s.map(one)

    return cut(text)
