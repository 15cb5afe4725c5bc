"""Vectorised bit counting for 64-bit similarity hashes."""

from __future__ import annotations

import numpy as np

# Byte k of entry v is bit k of v: eight counters of eight bits in one word.
_SPREAD = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype("uint8").view("uint64").ravel()
_RUN = 255


def majority(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One 64-bit word per segment of ``hashes``: a bit is 1 if it is set in over half of the segment.

    ``lengths`` are the segments' sizes in order; an empty segment gives 0.
    """
    return decide(counts(hashes, lengths), lengths)


def counts(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(segments, 64): how many hashes of each segment have each bit set.

    Runs of at most 255 hashes are added as packed bytes, runs of a segment as integers.
    """
    out = np.zeros((len(lengths), 64), "int64")
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    size = lengths[full]
    runs = -(-size // _RUN)
    first_run = np.concatenate([[0], np.cumsum(runs)[:-1]])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    starts = np.repeat(first, runs) + _RUN * (np.arange(runs.sum()) - np.repeat(first_run, runs))
    packed = np.add.reduceat(_SPREAD[hashes.view("uint8").reshape(-1, 8)], starts, axis=0)
    out[full] = np.add.reduceat(packed.view("uint8").reshape(-1, 64), first_run, axis=0, dtype="int64")
    return out


def decide(count: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.packbits(2 * count > lengths[:, None], axis=1, bitorder="little").view("uint64").ravel()
