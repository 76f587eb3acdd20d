"""Vectorised token and line hashing straight from Arrow text buffers (numpy only).

A token is a run of bytes between separator bytes and never crosses a document.
Its 64-bit hash is made of two polynomial hashes of its bytes, modulo two primes
under 2**31, finished with a mixing step. (Modulo 2**64 no base is safe: regular
words of two letters, such as the Thue-Morse word and its complement, collide.)
Two different texts of n bytes agree modulo one prime for at most n of its bases.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = b" \t\n\x0b\x0c\r"
#: The two primes and a base for each.
PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (1_640_531_527, 1_013_904_243)


def text_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    wide = pa.types.is_large_string(col.type)
    if n == 0 or col.buffers()[1] is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1]
    off = off.astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def parts(off: np.ndarray, max_bytes: int = 500_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``max_bytes`` each; one longer text is a range of its own."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def _mod(x: np.ndarray, p: int) -> np.ndarray:
    q = np.uint64(p)
    return x - x // q * q


@lru_cache(maxsize=8)
def _powers(size: int, base: int, p: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    n = 1
    while n < size:
        k = min(n, size - n)
        out[n : n + k] = _mod(out[:k] * np.uint64(pow(base, n, p)), p)
        n += k
    return out


def powers(n: int, which: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of a base, or of its inverse, modulo its prime."""
    p, base = PRIMES[which], BASES[which]
    return _powers(1 << max(19, int(n).bit_length()), pow(base, -1, p) if inverse else base, p)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing step of a 64-bit hash (Stafford's variant 13)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running sums of values[i] * base**i with a leading 0, one row for each prime; they stay under 2**64 and are
    brought below the prime only where two of them are subtracted."""
    out = np.zeros((2, len(values) + 1), np.uint64)
    top = int(values.max(initial=0))
    for row, p in enumerate(PRIMES):
        terms = (values if top < p else _mod(values, p)) * powers(len(values), row)
        if min(top, p) * p * len(values) >= 1 << 64:
            terms = _mod(terms, p)
        np.cumsum(terms, out=out[row, 1:])
    return out


def between(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, origin: np.ndarray) -> np.ndarray:
    """The sums from starts to ends with the powers counted from ``origin``, both primes' in one number."""
    out = []
    for row, p in enumerate(PRIMES):
        diff = _mod(prefix[row][ends] - prefix[row][starts], p)
        out.append(_mod(diff * powers(prefix.shape[1], row, inverse=True)[origin], p))
    return out[0] << np.uint64(31) | out[1]


def shifted_difference(high: int, low: int, by: int) -> tuple[int, ...]:
    """What ``between`` gives for a stretch: from its running sums at the end and at the start of it, ``by`` bytes
    after where they were counted from."""
    mask = (1 << 31) - 1
    parts = zip(((high >> 31) - (low >> 31), (high & mask) - (low & mask)), PRIMES, BASES, strict=True)
    return tuple(d * pow(base, -by, p) % p for d, p, base in parts)


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(between(prefix, starts, ends, starts) + mix((ends - starts).astype(np.uint64)))


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)


def tokens(buf: np.ndarray, off: np.ndarray, separators: bytes = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document index) of every token; ``off`` counts from the start of ``buf``."""
    sep = np.zeros(256, bool)
    sep[list(separators)] = True
    inside = np.zeros(len(buf) + 1, bool)
    inside[:-1] = ~sep[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = np.zeros(len(buf) + 1, bool)  # document starts cut a run
    cut[off[:-1]] = True
    cut[-1] = False
    first |= cut & inside
    last = inside[:-1] & (~inside[1:] | cut[1:])
    starts = np.flatnonzero(first[:-1])
    ends = np.flatnonzero(last) + 1
    doc = np.searchsorted(off, starts, side="right") - 1
    return starts, ends, doc


def token_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(buf.astype(np.uint64) + np.uint64(1)), starts, ends)


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of every run of ``width`` tokens of a document; a shorter non-empty
    document has one shingle of all its tokens. bounds[d]:bounds[d+1] are document d's."""
    count = np.bincount(doc, minlength=n_docs)
    begin = np.concatenate([[0], np.cumsum(count)])
    prefix = prefix_hash(h)
    number = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(number)])
    which = np.repeat(np.arange(n_docs), number)
    start = begin[which] + (np.arange(bounds[-1]) - bounds[which])
    return span_hash(prefix, start, start + np.minimum(width, count[which])), bounds
