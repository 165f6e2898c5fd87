"""Encoding with a public byte-level BPE vocabulary: speculate and verify.

A sequence of tokens is the BPE encoding of a word exactly when every pair of neighbours is
(each pair being what BPE makes of the two tokens' bytes together).  So each new word is
first cut greedily into the longest tokens, the pairs of all words of a batch are checked
together as an array of keys against known verdicts, and only the words with a failing pair
are merged exactly.  Words met before are looked up.

Defined results: null and empty texts have the empty list of ids; strings that look like
special tokens are ordinary text; texts of any length are encoded whole; rows are kept one to
one; repeated rows get equal ids.  No shuffle; the vocabulary is a file of fixed size that the driver hands
to the executors; each Python worker reads it once.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkContext, SparkFiles
from pyspark.sql import Column
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
#: Fixed value: the published pattern that cuts a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and pairs remembered by a worker; beyond it the memory is emptied, which costs only time.
REMEMBERED = 1_000_000


class Encoder:
    """Words and texts to ids in one vocabulary of (bytes, rank) lines."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.prefixes = {t[:i] for t in self.ranks for i in range(1, len(t) + 1)}
        self.split = regex.compile(PATTERN).findall
        self.exact = tiktoken.Encoding("one word", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}

    def greedy(self, data: bytes) -> list[int]:
        """The longest token at each place, left to right."""
        ranks, prefixes, out, at, n = self.ranks, self.prefixes, [], 0, len(data)
        while at < n:
            end = best = at + 1
            while end < n and data[at : end + 1] in prefixes:
                end += 1
                if data[at:end] in ranks:
                    best = end
            out.append(ranks[data[at:best]])
            at = best
        return out

    def merged(self, data: bytes) -> list[int]:
        """Exact merging of a short byte string: the pair of lowest rank first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of neighbours stays apart under merging."""
        keys, where = np.unique(left.astype(np.int64) << 20 | right, return_inverse=True)
        verdicts = np.empty(len(keys), bool)
        for i, k in enumerate(keys.tolist()):
            known = self.pairs.get(k)
            if known is None:
                a, b = k >> 20, k & 0xFFFFF
                known = self.pairs[k] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            verdicts[i] = known
        return verdicts[where]

    def learn(self, words: list[str]) -> None:
        """Encode words not met before."""
        whole: list[tuple[str, list[int]]] = []
        for w in words:
            data = w.encode()
            r = self.ranks.get(data)
            if r is not None:
                self.words[w] = (r,)
            else:
                whole.append((w, self.greedy(data)))
        if not whole:
            return
        ids = np.fromiter((t for _, g in whole for t in g), np.int64)
        owner = np.repeat(np.arange(len(whole)), [len(g) for _, g in whole])
        inside = owner[1:] == owner[:-1]
        good = np.ones(len(whole), bool)
        good[owner[1:][inside][~self.compatible(ids[:-1][inside], ids[1:][inside])]] = False
        failed = [w for (w, _), ok in zip(whole, good, strict=True) if not ok]
        self.words.update((w, tuple(g)) for (w, g), ok in zip(whole, good, strict=True) if ok)
        self.words.update((w, tuple(g)) for w, g in zip(failed, self.exact.encode_ordinary_batch(failed, num_threads=1), strict=True))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if len(self.pairs) > 4 * REMEMBERED:
            self.pairs.clear()
        cut = [self.split(t) if t else [] for t in texts]
        self.learn(list({w for words in cut for w in words if w not in self.words}))
        known = self.words
        return [[i for w in words for i in known[w]] for words in cut]


@lru_cache(maxsize=4)
def encoder(name: str, folder: str) -> Encoder:
    return Encoder(os.path.join(folder, f"{name}.tiktoken"))


def _handed(vocabulary: str, folder: str) -> Callable[[], Encoder]:
    """The encoder in a worker: of the file as the driver's file server hands it to the executors; ``folder`` itself is
    read there only if the driver has no such file."""
    path = os.path.join(folder, f"{vocabulary}.tiktoken")
    sent = os.path.exists(path)
    if sent:
        SparkContext.getOrCreate().addFile(path)
    return lambda: encoder(vocabulary, SparkFiles.getRootDirectory() if sent else folder)


def token_ids(text: Column, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> Column:
    """array<int> of the ids of ``text``."""
    handed = _handed(vocabulary, folder)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = handed()
        for texts in batches:
            yield pd.Series(e.encode([t if isinstance(t, str) else None for t in texts]), dtype=object)

    return ids(text)


def token_count(text: Column, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> Column:
    """long: the number of ids of ``text``."""
    handed = _handed(vocabulary, folder)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = handed()
        for texts in batches:
            yield pd.Series([len(i) for i in e.encode([t if isinstance(t, str) else None for t in texts])], dtype="int64")

    return count(text)
