"""Words of texts in Python, as the Arrow-based operators read them."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE = 500
#: Only the GNU C library has it.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in order, A to Z lower-cased. bytes.split() cuts at exactly the six blanks of the contract and
    bytes.lower() changes A to Z only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def fold_of(doc_id: int | None, n: int) -> int:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


class Vocabulary(dict):
    """Local numbers of words, in order of first sight, with their 64-bit hashes."""

    def __init__(self, *special: int):
        super().__init__()
        self.hashes = list(special)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def array(self) -> np.ndarray:
        return np.array(self.hashes, np.uint64)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of the named columns, of which only a few are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield from zip(*[batch.column(n).slice(at, SLICE).to_pylist() for n in names], strict=True)


def release() -> None:
    """Give what has been freed back to the system: a worker lives on between tasks, and its peaks would add up."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))
