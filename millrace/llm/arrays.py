"""Whole texts of an Arrow batch as flat numpy arrays: bytes, words and hashes. Helpers that run inside tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once; bounds the memory of the helper arrays, not what is hashed.
SPAN = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)
#: Words of more bytes are hashed one by one.
LONG = 256
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_RANDOM = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_powers: dict[str, np.ndarray] = {}


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and where each begins (one more entry than texts). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch | pa.Table, text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch | pa.Table]:
    """Cut a batch into runs of rows with about ``most`` bytes of text; a longer text is a run of its own."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(sizes) // most
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1, [len(sizes)]])
    for low, high in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(low, high - low)
    pa.default_memory_pool().release_unused()  # workers live on between tasks


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's factor and of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SPAN + (1 << 12))
        for name, factor in (("up", _FACTOR), ("down", _INVERSE)):
            values = np.full(size, factor)
            values[0] = 1
            _powers[name] = np.multiply.accumulate(values)
    return _powers["up"], _powers["down"]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any substring follows, see ``hash_of``. For strings of a few hundred bytes:
    longer ones can be built that agree by pattern."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RANDOM[data] * powers(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def hash_of(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mixed((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and text number of each run of bytes other than ASCII white space."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = word[edges]
    last[edges - 1] = word[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word (A-Z in lower case): its bytes are taken eight at a time, each time mixed anew.

    Unlike sums of powers modulo 2^64 this has no patterns of letters on which different words agree. Words of more
    than ``LONG`` bytes are hashed whole by BLAKE2. Hashes of another ``seed`` are independent.
    """
    text = LOWER[data] if lower else data
    sizes = ends - starts
    out = mixed(sizes.astype(np.uint64) * _FACTOR + np.uint64(seed))
    eight = np.ndarray(len(text) + 1, "<u8", np.concatenate([text, np.zeros(8, np.uint8)]), strides=(1,))
    live = np.flatnonzero(sizes <= LONG)
    for done in range(0, LONG, 8):
        live = live[sizes[live] > done]
        if len(live) == 0:
            break
        left = sizes[live] - done
        part = eight[starts[live] + done]
        part &= ~np.uint64(0) >> (np.uint64(8) * np.uint64(8) - np.uint64(8) * np.minimum(left, 8).astype(np.uint64))
        out[live] = mixed((out[live] ^ part) * _ODD)
    for k in np.flatnonzero(sizes > LONG):
        digest = hashlib.blake2b(text[starts[k] : ends[k]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        out[k] = int.from_bytes(digest, "little")
    return out


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingles of ``width`` words, as 64-bit hashes.

    With fewer words the whole sequence is one shingle; without words the set is empty. Equal shingles have equal
    hashes; different ones share a hash with a chance of about 2^-64.
    """
    data, offsets = flat(column)
    starts, ends, text = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    bounds = np.searchsorted(text, np.arange(len(offsets)))
    joined = hashes.copy()
    for k in range(1, min(width, len(hashes))):
        joined[: len(hashes) - k] = mixed(joined[: len(hashes) - k] * _FACTOR + hashes[k:])
    sets = []
    for low, high in zip(bounds[:-1], bounds[1:]):
        if high - low >= width:
            some = np.sort(joined[low : high - width + 1])
            sets.append(some[np.concatenate([[True], some[1:] != some[:-1]])])
        elif high > low:
            one = hashes[low : low + 1].copy()
            for k in range(low + 1, high):
                one = mixed(one * _FACTOR + hashes[k : k + 1])
            sets.append(mixed(one + np.uint64(high - low)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
