"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import functools
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The vocabulary used where none is named: byte-level BPE for many languages.
DEFAULT_FILE = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

#: Fixed value: how a byte-level vocabulary cuts a text before it merges bytes.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Sizes(dict):
    """Tokens of pretokens, by need.  It saves time only and is emptied when it is large."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        if len(self) >= 1 << 19:
            self.clear()
        n = self[piece] = len(self.encode(piece))
        return n


class ByteBpe:
    """Ranks file of a byte-level vocabulary."""

    def __init__(self, path: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).open("rb"))}
        self.encoding = tiktoken.Encoding(Path(path).stem, pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PRETOKENS)
        self.sizes = _Sizes(self.encoding.encode_ordinary)

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def between(self, text: str, places: np.ndarray, before: np.ndarray, a: int, b: int) -> int:
        """Tokens of the text from ``a`` to ``b`` if it stood alone, as :meth:`count` would say.

        Pretokens are the same as inside the text from the first whole one on, but for blanks at its end, which are one pretoken there."""
        last = b
        if b < len(text):
            while last > a and text[last - 1].isspace():
                last -= 1
        i, j = int(np.searchsorted(places, a)), int(np.searchsorted(places, last, "right")) - 1
        if i > j:
            return self.count(text[a:b])
        n = int(before[j] - before[i])
        if places[i] > a:
            n += self.count(text[a : int(places[i])])
        return n + self.count(text[int(places[j]) : b]) if places[j] < b else n

    def steps(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places at which the text can be cut between tokens, and the tokens before each."""
        parts = self.pattern.findall(text)
        n = np.fromiter(map(self.sizes.__getitem__, parts), np.int64, len(parts))
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.r_[0, np.cumsum(length)], np.r_[0, np.cumsum(n)]


class FastBpe:
    """A tokenizer in one JSON file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True

    def count(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def between(self, text: str, places: np.ndarray, before: np.ndarray, a: int, b: int) -> int:
        return self.count(text[a:b])

    def steps(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ends = [e for _, e in self.tokenizer.encode(text, add_special_tokens=False).offsets]
        return _steps(ends, len(text))


class Pieces:
    """A sentence-piece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1))

    def between(self, text: str, places: np.ndarray, before: np.ndarray, a: int, b: int) -> int:
        return self.count(text[a:b])

    def steps(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ends = np.fromiter((p.end for p in self.model.encode(text, return_type="proto", num_threads=1).pieces), np.int64)
        raw = np.frombuffer(text.encode(), np.uint8)
        begun = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]  # characters that have begun before each byte
        return _steps(begun[ends].tolist(), len(text))


def _steps(ends: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.maximum.accumulate(np.asarray([0, *ends], np.int64)) if ends else np.zeros(1, np.int64)
    last = np.flatnonzero(np.r_[at[1:] != at[:-1], True])  # several tokens may share one character
    places, before = at[last], last.astype(np.int64)
    return (places, before) if places[-1] == length else (np.r_[places, length], np.r_[before, before[-1]])


@functools.cache
def tokenizer(path: str = DEFAULT_FILE) -> ByteBpe | FastBpe | Pieces:
    """The tokenizer of a file, once a process."""
    kinds = {".tiktoken": ByteBpe, ".json": FastBpe, ".model": Pieces}
    if Path(path).suffix not in kinds:
        raise ValueError(f"no tokenizer for {path}")
    return kinds[Path(path).suffix](path)


def count_tokens(c: Column, path: str = DEFAULT_FILE) -> Column:
    """Tokens of a whole text; 0 for null and empty texts."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        size = tokenizer(path).count
        return pd.Series([size(t) if isinstance(t, str) and t else 0 for t in texts], dtype="int64")

    return count(c)
