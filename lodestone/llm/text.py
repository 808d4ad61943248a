"""Shared text helpers.

A word is a run of code points outside U+0020 and U+0009..U+000D.  bytes.split()
separates on exactly those six characters and bytes.lower() changes only A-Z, so UTF-8
bytes give the contract's words without a regular expression.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.shared import cut, shared_dir

__all__ = ["LINK", "WORD", "Vocabulary", "cut", "encode", "mix64", "remainder", "shared_dir", "table", "windows", "words_of"]
WORD = r"[^\x20\x09-\x0D]+"
LINK = 0x9E3779B97F4A7C15


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "replace")


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8 bytes, A-Z lower-cased; null has none."""
    return encode(text).lower().split()


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3's) over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Vocabulary(dict):
    """The 64-bit hash of each word, remembered.

    Forgets everything once it holds `most` words, so a worker's memory stays bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def hashed(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive 64-bit hashes of all windows of `width` word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out * np.uint64(LINK)) ^ (hashes[k : k + n] + (out >> np.uint64(29)))
    return mix64(out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
