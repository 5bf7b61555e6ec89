"""Vectorised words, hashes and rolling windows over Arrow string columns.

A word's hash is a polynomial over random values of its bytes, a window's hash a polynomial
over its words' hashes, both modulo 2**64 and finished by a bit mixer. With prefix sums either
costs a few passes of numpy over the text, whatever the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20_240_611).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 1 << 20
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, _CHUNK + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a hash so that each bit depends on all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_classes(separators: bytes = b" \t\n\x0b\x0c\r") -> np.ndarray:
    """Class of each byte: 0 for separators, 1 for what words are made of."""
    out = np.ones(256, np.uint8)
    out[list(separators)] = 0
    return out


def lower_ascii() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


class Column(NamedTuple):
    """A string column as bytes; row ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray


def column(array: pa.Array) -> Column:
    """Bytes of a string or binary column; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = pc.fill_null(array, "" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if not len(array):
        return Column(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(array) + 1, array.offset * (8 if wide else 4))
    return Column(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at.astype(np.int64))


def chunks(text: Column) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about a megabyte; a longer row is a range of its own."""
    n, lo = len(text.offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(text.offsets, text.offsets[lo] + _CHUNK, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words(NamedTuple):
    """Words of consecutive rows: row number, place in the column's data, hash; ``first[i]`` is row ``i``'s first word."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def words(text: Column, lo: int, hi: int, classes: np.ndarray, fold: np.ndarray | None = None) -> Words:
    """Maximal runs of one non-zero class of byte in rows ``lo`` to ``hi``; ``fold`` maps bytes before hashing."""
    base = int(text.offsets[lo])
    raw = text.data[base : int(text.offsets[hi])]
    at = text.offsets[lo : hi + 1] - base
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64), np.zeros(hi - lo + 1, np.int64))
    kind = classes[raw]
    edge = np.empty(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[0] = edge[n] = True
    edge[at] = True
    cuts = np.flatnonzero(edge)
    inside = kind[cuts[:-1]] != 0
    start, end = cuts[:-1][inside], cuts[1:][inside]
    values = _BYTE_VALUES if fold is None else _BYTE_VALUES[fold]
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values[raw] * _power_table(_BASE, n), out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * _power_table(_BASE_INVERSE, n + 1)[start])
    first = np.searchsorted(start, at)
    row = np.repeat(np.arange(hi - lo), np.diff(first))
    return Words(row, start + base, end + base, hashes, first)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive words, from each place where so many follow."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(hashes * _power_table(_BASE, n), out=sums[1:])
    return mix((sums[size:] - sums[: n - size + 1]) * _power_table(_BASE_INVERSE, n - size + 1) + np.uint64(size))


def within_row(row: np.ndarray, size: int) -> np.ndarray:
    """Which windows of ``windows`` lie in one row."""
    n = len(row)
    return row[: max(0, n - size + 1)] == row[size - 1 :] if n >= size else np.zeros(0, bool)


class BitSet:
    """Bits of fixed number, addressed by a hash's leading bits. False positives are possible, misses are not."""

    def __init__(self, log2: int, packed: bytes | None = None):
        self.shift = np.uint64(64 - log2)
        self.packed = np.zeros(1 << (log2 - 3), np.uint8) if packed is None else np.frombuffer(packed, np.uint8)

    @classmethod
    def read(cls, packed: bytes) -> BitSet:
        return cls(len(packed).bit_length() + 2, packed)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def bits_for(keys: int, most: int, least: int = 20) -> int:
    """Size (a power of two) of a filter for so many keys: 64 bits a key or more, from ``least`` up to ``most``.

    A filter that is too full lets more pass, never less; the join behind it drops the rest.
    """
    return min(most, max(least, int(np.ceil(np.log2(max(1, keys)))) + 6))


def collect_bits(keys: DataFrame, name: str, log2: int) -> bytes:
    """Bits of all values of a column of 64-bit hashes, gathered as words of 64 bits."""
    at = F.shiftrightunsigned(name, 64 - log2)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({name}, {64 - log2}) & 63 as int))")
    filled = keys.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    return bitset_bytes(log2, filled["word"].to_numpy(), filled["bits"].to_numpy())


def bitset_bytes(log2: int, index: np.ndarray, bits: np.ndarray) -> bytes:
    """Packed bits from 64-bit words (index, value); the rest is zero."""
    full = np.zeros(1 << (log2 - 6), np.uint64)
    full[index] = bits.astype(np.int64).view(np.uint64)
    return full.view(np.uint8).tobytes()
