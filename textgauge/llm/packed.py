"""Vectorised text primitives over Arrow string columns.

Every operator of this subpackage that may choose its style freely works on whole Arrow batches: the texts of a batch are
one byte buffer with offsets, words are spans of that buffer, and words and shingles are 64-bit hashes got by a prefix
polynomial in wrap-around arithmetic.  Nothing here loops over words in Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the polynomial; odd numbers have an inverse modulo 2**64.
BASE = U64(0x9E3779B97F4A7C15)
BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Texts are handled in slices of about so many bytes, which bounds a worker's memory.
SLICE_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[str, np.ndarray] = {}


def powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.empty(size, dtype=U64)
        have[0] = 1
        done = 1
        while done < size:  # doubling: the second half is the first times base**done
            step = U64(pow(int(base), done, 1 << 64))
            have[done : 2 * done] = have[:done] * step
            done *= 2
        _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def trim() -> None:
    """Gives the memory that this worker has freed back to the machine: workers stay for the tasks after theirs."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of each piece hold about `most` bytes; one longer text is a piece of its own.

    When the last piece is done, the worker's free memory is given back.
    """
    yield from _pieces(batches, text, most)
    _powers.clear()
    trim()


def _pieces(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_buffer(batch.column(text))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
            end = min(max(end, start + 1), start + SLICE_TEXTS, batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and the text's index of all maximal runs of bytes that aren't white space; runs end at text borders."""
    n = len(raw)
    if n == 0:
        none = np.empty(0, np.int64)
        return none, none, none
    word = ~SPACE[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    begins[cuts] = word[cuts]
    closes = word.copy()
    closes[:-1] &= ~word[1:]
    last = cuts[cuts > 0] - 1
    closes[last] = word[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever the span lies."""
    n = len(raw)
    if n == 0 or len(starts) == 0:
        return np.zeros(len(starts), U64)  # what an empty span has anywhere
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum((raw.astype(U64) + U64(1)) * powers("p", BASE, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers("i", BASE_INV, n + 1)[starts]  # an empty span may begin at the end
    return mix(h + (ends - starts).astype(U64))


class Words:
    """The words of one slice of texts: `hash` by word, `first` and `count` by text."""

    def __init__(self, column: pa.Array, lower: bool = True):
        raw, offsets = text_buffer(column)
        self.raw = LOWER[raw] if lower else raw
        self.offsets = offsets
        self.texts = len(offsets) - 1
        self.starts, self.ends, self.text = word_spans(self.raw, offsets)
        self.hash = span_hashes(self.raw, self.starts, self.ends)
        self.count = np.bincount(self.text, minlength=self.texts).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count

    def shingles(self, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text) of each run of k words; a text of fewer words, but one at least, has its whole sequence as one."""
        return shingle_hashes(self.hash, self.text, self.count, self.first, k)


def shingle_hashes(h: np.ndarray, text: np.ndarray, count: np.ndarray, first: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    n = len(h)
    if n == 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    sums = np.zeros(n + 1, U64)
    np.cumsum(h * powers("p", BASE, n), out=sums[1:])
    inverse = powers("i", BASE_INV, n)
    at = np.arange(n)
    whole = at + k <= (first + count)[text]
    begin = at[whole]
    out = mix((sums[begin + k] - sums[begin]) * inverse[begin] + U64(k))
    owner = text[whole]
    few = np.flatnonzero((count > 0) & (count < k)) if short else ()
    if len(few):
        a, b = first[few], first[few] + count[few]
        out = np.concatenate([out, mix((sums[b] - sums[a]) * inverse[a] + count[few].astype(U64))])
        owner = np.concatenate([owner, few])
    return out, owner


#: Identity of a shingle where sets are compared: so many bits of its hash; a slice has 2**12 texts at most.
KEY_BITS = 51
SLICE_TEXTS = 1 << 12


def distinct_by_text(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (51-bit key, text) pairs of a slice, ordered by text, then key: one sort of plain integers."""
    x = np.sort((text.astype(U64) << U64(KEY_BITS + 1)) | (h >> U64(64 - KEY_BITS)))
    if len(x):
        keep = np.ones(len(x), bool)
        np.not_equal(x[1:], x[:-1], out=keep[1:])
        x = x[keep]
    return x & U64((1 << KEY_BITS) - 1), (x >> U64(KEY_BITS + 1)).astype(np.int64)


def member_of(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted table."""
    if len(table) == 0:
        return np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return table[at] == keys


def column(values, kind: pa.DataType) -> pa.Array:
    return pa.array(values, type=kind)


_CODEC: list[pa.Codec] = []


def pack(*arrays: np.ndarray) -> bytes:
    """The arrays as one block: the bytes of each are dealt by their place in the number, which leaves long runs, then zstd."""
    if not _CODEC:
        _CODEC.append(pa.Codec("zstd", 1))
    heads, bodies = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        body = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
        squeezed = _CODEC[0].compress(body, asbytes=True) if body else b""
        heads.append(np.array([ord(a.dtype.kind), a.itemsize, len(a), len(squeezed)], np.uint32).tobytes())
        bodies.append(squeezed)
    return bytes([len(arrays)]) + b"".join(heads) + b"".join(bodies)


def unpack(block: bytes) -> list[np.ndarray]:
    if not _CODEC:
        _CODEC.append(pa.Codec("zstd", 1))
    heads = np.frombuffer(block, np.uint32, 4 * block[0], 1).reshape(-1, 4)
    at, out = 1 + 16 * block[0], []
    for kind, size, n, squeezed in heads.tolist():
        dtype = np.dtype(f"{chr(kind)}{size}")
        if n:
            body = _CODEC[0].decompress(block[at : at + squeezed], n * size, asbytes=True)
            out.append(np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(size, n).T).view(dtype).ravel())
        else:
            out.append(np.empty(0, dtype))
        at += squeezed
    return out
