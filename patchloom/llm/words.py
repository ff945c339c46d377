"""Word and shingle hashes of whole Arrow batches, computed on the text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_STEP = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
#: Spans are hashed by two polynomials, modulo primes 2^31 - c with these c, and their length.
#: Modulo a power of two there are short texts that collide for every base.
_PRIMES = ((1, 1_284_865_837), (19, 1_917_260_531))
_LOW_BITS = np.uint64((1 << 31) - 1)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (splitmix64's last steps)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def _reduced(x: np.ndarray, c: int) -> np.ndarray:
    """``x`` below 2^62 modulo 2^31 - c, as a number of at most 32 bits."""
    for _ in range(2):
        high = x >> np.uint64(31)
        x = x & _LOW_BITS
        x += high if c == 1 else high * np.uint64(c)
    return x


def _byte_values(lower: bool) -> list[np.ndarray]:
    code = np.arange(256, dtype=np.uint64)
    if lower:
        code[65:91] += np.uint64(32)
    spread = mix((code + np.uint64(1)) * np.uint64(_STEP))
    return [spread >> np.uint64(33), (spread & np.uint64((1 << 30) - 1)) + np.uint64(1)]


_VALUES = {True: _byte_values(True), False: _byte_values(False)}
_powers: dict[tuple[int, int], np.ndarray] = {}


def _power_table(c: int, base: int, size: int) -> np.ndarray:
    """Powers of ``base`` modulo 2^31 - c, ``size`` of them at least."""
    table = _powers.get((c, base))
    if table is None or len(table) < size:
        prime, wanted = (1 << 31) - c, max(size, 1 << 16)
        table = np.ones(1, np.uint32)
        while len(table) < wanted:
            more = table[: wanted - len(table)] * np.uint64(pow(base, len(table), prime)) % np.uint64(prime)
            table = np.concatenate([table, more.astype(np.uint32)])
        if size <= 2 * BLOCK_BYTES:
            _powers[c, base] = table
    return table


class Block:
    """Some texts of a batch as one byte buffer: ``offsets[i]:offsets[i + 1]`` is text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.rows = len(offsets) - 1

    def prefix(self, lower: bool) -> list[np.ndarray]:
        """Running sums from which the hash of any span follows."""
        size, found = len(self.data), []
        for (c, base), values in zip(_PRIMES, _VALUES[lower]):
            sums = np.zeros(size + 1, dtype=np.uint64)
            np.cumsum(_reduced(values[self.data] * _power_table(c, base, size)[:size], c), out=sums[1:])
            found.append(sums)
        return found

    def span_hash(self, sums: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64 bits for each span; equal for equal bytes wherever they stand."""
        found = mix((ends - starts).astype(np.uint64) * np.uint64(_STEP))
        for (c, base), upto in zip(_PRIMES, sums):
            prime = (1 << 31) - c
            inverse = _power_table(c, pow(base, -1, prime), len(self.data) + 1)
            own = (upto[ends] - upto[starts]) % np.uint64(prime)
            own = own * inverse[starts] % np.uint64(prime)
            found = found * np.uint64(1 << 31) + own if c == 1 else mix(found ^ (own * np.uint64(_BASE)))
        return found

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and ``bounds``: text i has words bounds[i]:bounds[i+1]."""
        inside = ~SPACE[self.data]
        size = len(inside)
        cut = np.zeros(size + 1, dtype=bool)
        cut[self.offsets] = True
        before = np.zeros(size, dtype=bool)
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | cut[:size]))
        after = np.zeros(size, dtype=bool)
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, Block]]:
    """The first row and the block of consecutive runs of rows; a null text is an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + block_bytes, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        low, high = int(offsets[first]), int(offsets[last])
        yield first, Block(data[low:high], offsets[first : last + 1] - low)
        first = last


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and the bounds of each text's runs.

    A text with fewer words, but some, has one run: all of them.
    """
    total = len(hashes)
    lengths = np.diff(bounds)
    text = np.repeat(np.arange(len(lengths)), lengths)
    joined = np.zeros(max(total - size + 1, 0), dtype=np.uint64)
    for k in range(size):
        joined = mix(joined * np.uint64(_BASE) + hashes[k : k + len(joined)])
    keep = text[: len(joined)] == text[size - 1 :] if len(joined) else np.zeros(0, bool)
    counts = np.maximum(lengths - size + 1, 0)
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    full = joined[keep]
    if not len(short):
        return full, np.concatenate([[0], np.cumsum(counts)])
    few = np.full(len(short), _STEP, dtype=np.uint64) * lengths[short].astype(np.uint64)
    for k in range(size - 1):
        has = lengths[short] > k
        few[has] = mix(few[has] * np.uint64(_BASE) + hashes[bounds[short[has]] + k])
    at = np.concatenate([[0], np.cumsum(counts)])
    full = np.insert(full, at[short], few)
    counts[short] = 1
    return full, np.concatenate([[0], np.cumsum(counts)])


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of each text, A-Z lower-cased."""
    for first, block in blocks(texts):
        starts, ends, bounds = block.words()
        hashes = block.span_hash(block.prefix(True), starts, ends)
        runs, at = windows(hashes, bounds, size)
        for i in range(block.rows):
            yield first + i, np.unique(runs[at[i] : at[i + 1]])
