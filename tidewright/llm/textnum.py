"""Words, lines and shingles of many texts at once, as numpy arrays over their UTF-8 bytes.

Every delimiter used here is one ASCII byte, so cutting the bytes is cutting the text. Hashes have 64 bits: a polynomial over a
byte table of random numbers, from prefix sums, then mixed. They stand for the words; equal words have equal hashes everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Texts are cut into slices of about so many bytes; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def byte_set(*parts: bytes | tuple[int, int]) -> np.ndarray:
    """Lookup table of 256 booleans: bytes given singly or as inclusive ranges."""
    out = np.zeros(256, bool)
    for p in parts:
        if isinstance(p, tuple):
            out[p[0] : p[1] + 1] = True
        else:
            out[list(p)] = True
    return out


#: Words `[^\x20\x09-\x0D]+`.
SPACE = byte_set(b" ", (0x09, 0x0D))
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text.
PUNCT = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def lower_latin(buf: np.ndarray) -> np.ndarray:
    """A-Z, and the capitals of U+00C0 to U+00DE, which are C3 80 to C3 9E in UTF-8."""
    out = _LOWER[buf]
    after = np.zeros(len(buf), bool)
    after[1:] = buf[:-1] == 0xC3
    up = after & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97)
    out[up] += 32
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of each text in them and the end). A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(at, at[row] + SLICE_BYTES, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def _grown(n: int) -> None:
    if len(_powers[0]) < n:
        m = max(n, 2 * SLICE_BYTES)
        for i, r in enumerate((_ODD, _INVERSE)):
            x = np.full(m, r, U)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running sums, one longer than ``buf``, for :func:`span_hash`."""
    _grown(len(buf) + 1)
    out = np.zeros(len(buf) + 1, U)
    np.cumsum(_TABLE[buf] * _powers[0][: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span [start, end)."""
    return mix((sums[end] - sums[start]) * _powers[1][start] + (end - start).astype(U))


def hash_text(text: str, salt: int = 0) -> int:
    """The hash that :func:`span_hash` gives the word ``text``."""
    buf = np.frombuffer(text.encode(), np.uint8)
    sums = prefix_hash(buf)
    return int(span_hash(sums, np.array([0]), np.array([len(buf)]))[0])


def words(buf: np.ndarray, at: np.ndarray, delimiter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``buf``, and for each text the index of its first word (and the number of words at the end)."""
    inside = ~delimiter[buf]
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(at), np.int64)
    edge = at[(at > 0) & (at < len(buf))]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, at, "left")


def owners(first: np.ndarray) -> np.ndarray:
    """Index of the text that each word belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(h: np.ndarray, owner: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k consecutive words of one text, and the index of the first word of each."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    out = h[:n].copy()
    for j in range(1, k):
        out = out * U(0xD6E8FEB86659FD93) + h[j : j + n]
    whole = np.flatnonzero(owner[:n] == owner[k - 1 : k - 1 + n])
    return mix(out[whole]), whole
