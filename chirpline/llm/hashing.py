"""The white-space chunks of many texts at once, in numpy, and 64-bit hashes of them.

A chunk of at most ``PACKED`` bytes is packed with its length into one number, which no other chunk
has. Longer ones are hashed over their bytes (xxh3).
"""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: An odd factor by which hashes are chained.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a chunk that fit a number beside their count.
PACKED = 7
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(PACKED + 1)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def chunk_edges(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the chunks, which are cut at ASCII white space."""
    blank = _BLANK[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(blank) and not blank[0]:
        edges = np.concatenate(([0], edges))
    if len(edges) % 2:
        edges = np.append(edges, len(blank))
    return edges[::2], edges[1::2]


def packed(raw: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of chunks of at most ``PACKED`` and their lengths, as one number each."""
    padded = raw + bytes(8)
    eight = np.ndarray((len(raw),), "<u8", padded, 0, (1,))[starts] if len(raw) else np.empty(0, np.uint64)
    return (eight & _MASKS[lengths]) | (lengths.astype(np.uint64) << np.uint64(8 * PACKED))


def chunk_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the chunks and a hash of each."""
    from xxhash import xxh3_64_intdigest

    starts, stops = chunk_edges(raw)
    lengths = stops - starts
    out = np.empty(len(starts), np.uint64)
    short = lengths <= PACKED
    out[short] = mix(packed(raw, starts[short], lengths[short]))
    long = np.flatnonzero(~short)
    out[long] = np.fromiter((xxh3_64_intdigest(raw[i:j]) for i, j in zip(starts[long].tolist(), stops[long].tolist())), np.uint64, len(long))
    return starts, out
