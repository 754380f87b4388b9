"""Words of texts as numbers, batch by batch, for the operators on word windows.

A word is a run of characters other than space and U+0009 to U+000D. Each word becomes the XXH64 of its bytes; windows
of words become 64-bit polynomials of those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd multipliers of the window polynomials.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in a row, and the bounds of each text's words in it. Null texts have no words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat, offsets = lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py()), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    there = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not there.all():
        flat = flat.filter(pa.array(there))
        offsets = np.concatenate(([0], np.cumsum(there)))[offsets]
    return flat, offsets


def hashes(words: pa.Array, seed: int = 0, make=None) -> np.ndarray:
    """XXH64 of each word; each distinct word is hashed once. ``make`` may change a distinct word first."""
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    distinct = coded.dictionary.to_pylist()
    if make:
        distinct = [make(x) for x in distinct]
    table = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in distinct), np.uint64, len(distinct))
    return table[coded.indices.to_numpy(zero_copy_only=False)] if len(distinct) else np.zeros(0, np.uint64)


def windows(words: np.ndarray, length: int, base: np.uint64 = BASES[0]) -> np.ndarray:
    """A 64-bit number for each run of ``length`` words; equal runs have equal numbers."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for k in range(1, length):
            out *= base
            out += words[k : k + n]
        return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their low bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))
