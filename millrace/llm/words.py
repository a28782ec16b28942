"""The word rule of the corpus operators: ``[^\\x20\\x09-\\x0D]+``."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Distinct words whose hashes a Python worker remembers; beyond it the memory is emptied, results stay the same.
REMEMBERED = 120_000


def word_count(text: Column) -> Column:
    """Number of words of a text, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def split_words(text: str | None) -> list[bytes]:
    """Words in UTF-8. ``bytes.split`` splits at exactly the six characters of the rule."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHashes(dict):
    """64-bit hash of each word, computed once per worker."""

    def __init__(self, normal: Callable[[bytes], bytes] | None = None):
        super().__init__()
        self.normal = normal

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(self.normal(word) if self.normal else word)
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _odd(seed: int, n: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bit mixer of 64-bit values (xor-shift and multiply, a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(hashes: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Hash of every run of ``size`` words: a random linear form of the word hashes, mixed."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, c in enumerate(_odd(seed, size)):
        out += hashes[k : k + n] * c
    return mixed(out)
