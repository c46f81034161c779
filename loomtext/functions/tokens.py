"""Tokenizers: a registry of libraries and encoders, and token counts, encodings and decodings as columns."""

from __future__ import annotations

import base64
import importlib.util
import os
import re
from collections.abc import Callable
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.text import token_count

GPT2_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


class TokenizerError(ValueError):
    pass


class _Ranks:
    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding(Path(path).stem, pat_str=GPT2_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text):
        return self.coder.encode_ordinary(text)

    def decode(self, ids):
        return self.coder.decode(ids)


class _Hugging:
    def __init__(self, path: str):
        from tokenizers import Tokenizer as T

        self.coder = T.from_file(path)
        self.coder.encode_special_tokens = True

    def encode(self, text):
        return self.coder.encode(text, add_special_tokens=False).ids

    def decode(self, ids):
        return self.coder.decode(ids)


class _Pieces:
    def __init__(self, path: str):
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, text):
        return self.coder.encode(text)

    def decode(self, ids):
        return self.coder.decode(ids)


#: Libraries: how a model file is opened, its suffix, and the module that must be there.
LIBRARIES: dict[str, tuple[Callable[[str], Tokenizer], str, str]] = {"tiktoken": (_Ranks, ".tiktoken", "tiktoken"), "tokenizers": (_Hugging, ".json", "tokenizers"), "sentencepiece": (_Pieces, ".model", "sentencepiece")}
_OPEN: dict[tuple[str, str], Tokenizer] = {}


def register(library: str, open_: Callable[[str], Tokenizer], suffix: str, module: str) -> None:
    LIBRARIES[library] = (open_, suffix, module)


def libraries() -> list[str]:
    return sorted(n for n, (_, _, module) in LIBRARIES.items() if importlib.util.find_spec(module))


def encoders(library: str, folder: str) -> list[str]:
    """The models of a library in a folder."""
    if library not in LIBRARIES:
        raise TokenizerError(f"unknown tokenizer library {library!r}; there are: {', '.join(sorted(LIBRARIES))}")
    return sorted(p.name for p in Path(folder).glob("*" + LIBRARIES[library][1]))


def tokenizer(library: str, model: str) -> Tokenizer:
    """Opened once in a process. Nothing is downloaded: the file must be there."""
    if library not in LIBRARIES:
        raise TokenizerError(f"unknown tokenizer library {library!r}; there are: {', '.join(sorted(LIBRARIES))}")
    if not os.path.exists(model):
        raise TokenizerError(f"no model file {model!r}")
    key = (library, model)
    if key not in _OPEN:
        _OPEN[key] = LIBRARIES[library][0](model)
    return _OPEN[key]


def counter(library: str | None = None, model: str = "") -> Callable[[str], int]:
    """Tokens of one text on the driver, as :func:`counts` says."""
    if library is None:
        return lambda text: len(re.findall(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]", text, re.ASCII))
    t = tokenizer(library, model)
    return lambda text: len(t.encode(text)) if text else 0


def counts(text: Column, library: str | None = None, model: str = "") -> Column:
    """Tokens of each text; without a library the built-in counter, which needs no Python."""
    if library is None:
        return token_count(text)

    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        t = tokenizer(library, model)
        return texts.map(lambda x: len(t.encode(x)) if x else 0)

    return run(text)


def encoded(text: Column, library: str, model: str) -> Column:
    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        t = tokenizer(library, model)
        return texts.map(lambda x: t.encode(x or ""))

    return run(text)


def decoded(ids: Column, library: str, model: str) -> Column:
    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        t = tokenizer(library, model)
        return lists.map(lambda x: t.decode([int(i) for i in x]))

    return run(ids)
