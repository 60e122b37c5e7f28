"""Words, word hashes and shingles of whole texts, inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash

#: Words are runs of ASCII digits and letters and of anything beyond ASCII; A-Z become lower case. Working on UTF-8
#: bytes is exact, as every byte of a character beyond ASCII is 0x80 or more.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CACHE_WORDS = 150_000
_SLICE_ROWS = 1024


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text; none for null."""
    return text.translate(_WORD_BYTES).split() if text else []


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows a thousand at a time, so that a task's Python objects stay few whatever the batch holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE_ROWS):
            yield batch.slice(at, _SLICE_ROWS)


def utf8(column: pa.Array) -> list[bytes | None]:
    """Values of a string column as UTF-8 bytes, without decoding them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash, remembered for the words seen last; alike on every machine."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, found: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words; a shorter text that has words is one shingle."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    out = hashes[: n - size + 1].copy()
    for i in range(1, size):
        out = out * _MIX + hashes[i : n - size + 1 + i]
    return mix(out)
