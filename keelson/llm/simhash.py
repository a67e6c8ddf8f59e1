"""64-bit SimHash fingerprints of whole texts.

Words are lower-cased in A-Z only; each shingle of three words (repeats counted) is
hashed by XXH64 with seed 42; a bit is set where over half of the hashes set it.
"""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 3
SEED = 42


def hashes(data: bytes, shingle: int = SHINGLE) -> list[int]:
    words = data.lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return [digest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]


def fingerprints(texts: list[bytes]) -> list[int]:
    """One signed 64-bit fingerprint for each text; zero for a text without words."""
    every = [hashes(t) for t in texts]
    sizes = np.array([len(x) for x in every])
    out = np.zeros(len(texts), np.int64)
    filled = np.flatnonzero(sizes)
    if filled.size:
        flat = np.array([h for x in every for h in x], np.uint64)
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.concatenate(([0], np.cumsum(sizes[filled])[:-1]))
        sums = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        over = (2 * sums > sizes[filled][:, None]).astype(np.uint8)
        out[filled] = np.packbits(over, axis=1, bitorder="little").view(np.int64)[:, 0]
    return out.tolist()
