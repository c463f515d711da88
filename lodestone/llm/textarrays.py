"""Array helpers over Arrow text batches: words, rolling hashes, content-defined anchors.

Everything here works on one Arrow batch at a time, in slices of about a megabyte,
and is called from inside ``mapInArrow`` tasks; nothing keeps state between batches.
Hashes are 64-bit, independent of process and platform, and always computed
over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xC2B2AE3D27D4EB4F
SLICE_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift) over unsigned arrays."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_CODE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = (n + (1 << 18) - 1) >> 18 << 18
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, dtype=U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))
        return self.up, self.down


_BYTES, _WORDS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


class Prefix:
    """Prefix sums of a coded sequence; ``of`` hashes any ranges of it."""

    def __init__(self, codes: np.ndarray, powers: _Powers):
        n = len(codes)
        up, self.down = powers.upto(n + 1)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(codes * up[:n], dtype=U64, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix64(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def byte_prefix(data: np.ndarray) -> Prefix:
    return Prefix(_BYTE_CODE[data], _BYTES)


def second_prefix(data: np.ndarray) -> Prefix:
    """As :func:`byte_prefix` with another base, for hashes that do not depend on its own."""
    return Prefix(_BYTE_CODE[data], _WORDS)


def word_prefix(codes: np.ndarray) -> Prefix:
    return Prefix(codes, _WORDS)


def second_word_prefix(codes: np.ndarray) -> Prefix:
    """As :func:`word_prefix` with another base, for hashes that do not depend on its own."""
    return Prefix(codes, _BYTES)


class Texts:
    """A slice of documents as one byte buffer; null texts are empty."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int):
        self.data, self.bounds, self.first = data, bounds, first
        self.n = len(bounds) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and document numbers of the words ``[^\\x20\\x09-\\x0D]+``."""
        if not len(self.data):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        inside = ~_SEPARATOR[self.data]
        opens = np.empty(len(inside), dtype=bool)
        opens[0], opens[1:] = inside[0], inside[1:] & ~inside[:-1]
        closes = np.empty(len(inside), dtype=bool)
        closes[-1], closes[:-1] = inside[-1], inside[:-1] & ~inside[1:]
        cuts = self.bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(inside))]
        opens[cuts] |= inside[cuts]
        closes[cuts - 1] |= inside[cuts - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        return starts, ends, np.searchsorted(self.bounds, starts, side="right") - 1

    def lowered(self) -> "Texts":
        """A-Z in lower case, other bytes as they are."""
        return Texts(_LOWER[self.data], self.bounds, self.first)


def slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int | None = None) -> Iterator[Texts]:
    """Whole documents of a string column in slices of about ``limit`` bytes (one long document may exceed it) and ``rows`` documents at most."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.type not in (pa.large_binary(),) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n, i + rows if rows else n)
        yield Texts(data[offsets[i] : offsets[j]], (offsets[i : j + 1] - offsets[i]).astype(np.int64), i)
        i = j


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the place of its smallest one, leftmost on ties."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    bits = max(1, int(len(values)).bit_length())
    packed = (values >> U64(bits) << U64(bits)) | np.arange(len(values), dtype=U64)
    span = 1
    while span * 2 <= width:
        packed = np.minimum(packed[:-span], packed[span:])
        span *= 2
    low = packed[:n] if span == width else np.minimum(packed[:n], packed[width - span : width - span + n])
    return (low & U64((1 << bits) - 1)).astype(np.int64)


def anchors(grams: np.ndarray, valid: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of windows: for each run of window starts that choose one gram, (gram place, first start, last start).

    ``grams[i]`` is the hash of the gram at place i and ``valid[i]`` tells whether a
    whole window starts at i. Equal windows choose the gram at the same place within
    them, so only windows whose chosen grams are equal can be equal.
    """
    place = sliding_argmin(grams, width)
    starts = np.flatnonzero(valid[: len(place)])
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    place = place[starts]
    new = np.empty(len(starts), dtype=bool)
    new[0] = True
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return place[first], starts[first], starts[last]
