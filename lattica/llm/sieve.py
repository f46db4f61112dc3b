"""Sketches and bitmaps in blocks, sized from counted data.

The high bits of a key name its block, and all its cells lie in that block: so a sketch of any size is a frame of
blocks, each put together by one task. Where all blocks stay within BROADCAST_BYTES they are sent to the tasks; a
larger sketch never leaves its frame, and the keys meet their blocks by a shuffle (see repeated_keys).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 2
BLOCK_LOG2 = 19
BROADCAST_BYTES = 256 << 20
HELD_KEYS = 1 << 22


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def blocks_for(keys: int, cells_each: float) -> int:
    """Blocks that give each of `keys` keys `cells_each` cells in every row of the sketch."""
    return max(1, -(-int(keys * cells_each) // (1 << BLOCK_LOG2)))


def size_of(blocks: int) -> int:
    """Bytes of a sketch of one bit a cell."""
    return blocks * (DEPTH << BLOCK_LOG2) // 8


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return ((mix(keys) >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def cells(keys: np.ndarray) -> list[np.ndarray]:
    """The cell of each key in each row, inside its block."""
    return [(mix(keys + np.uint64(d + 1)) >> np.uint64(64 - BLOCK_LOG2)).astype(np.int64) + (d << BLOCK_LOG2) for d in range(DEPTH)]


def parts_of(frame: DataFrame, keys_of: Callable[[pd.DataFrame], Iterator[np.ndarray]], blocks: int) -> DataFrame:
    """(block, keys, more): for each partition and block its keys, each once, and whether it saw them more than once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for pdf in batches:
            for k in keys_of(pdf):
                held.append(k)
                if sum(map(len, held)) > HELD_KEYS:
                    yield packed(np.concatenate(held))
                    held = []
        if held:
            yield packed(np.concatenate(held))

    def packed(keys: np.ndarray) -> pd.DataFrame:
        k, n = np.unique(keys, return_counts=True)
        b = block_of(k, blocks)
        order = np.argsort(b, kind="stable")
        b, k, n = b[order], k[order], n[order]
        cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])[: len(b)]
        ends = np.r_[cut[1:], len(b)]
        return pd.DataFrame({"block": b[cut], "keys": [k[i:j].tobytes() for i, j in zip(cut, ends)], "more": [np.packbits(n[i:j] > 1).tobytes() for i, j in zip(cut, ends)]})

    return frame.mapInPandas(run, "block long, keys binary, more binary")


def counted(pdf: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """The cells of a block counted up to two over all parts, and the keys of the parts."""
    count = np.zeros(DEPTH << BLOCK_LOG2, np.uint8)
    lists = []
    for raw, more in zip(pdf["keys"], pdf["more"]):
        k = np.frombuffer(raw, np.uint64)
        lists.append(k)
        n = np.unpackbits(np.frombuffer(more, np.uint8), count=len(k)).astype(np.uint8) + 1
        for c in cells(k):
            # keys of one part that share a cell add up as well
            i, at = np.unique(c, return_inverse=True)
            add = np.minimum(2, np.bincount(at, weights=n, minlength=len(i)))
            count[i] = np.minimum(2, count[i] + add).astype(np.uint8)
    return count, lists


def merged(parts: DataFrame, blocks: int, least: int) -> np.ndarray:
    """The whole sketch as bits: cells counted at least `least` times (1 or 2). Its size is checked by the caller."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf["block"][:1].tolist(), "bits": [np.packbits(counted(pdf)[0] >= least).tobytes()]})

    each = (DEPTH << BLOCK_LOG2) // 8
    out = np.zeros(blocks * each, np.uint8)
    for r in parts.groupBy("block").applyInPandas(merge, "block long, bits binary").toLocalIterator():
        out[r.block * each : (r.block + 1) * each] = np.frombuffer(r.bits, np.uint8)
    return out


def passes(keys: np.ndarray, bits: np.ndarray, blocks: int) -> np.ndarray:
    """Whether all cells of a key are set."""
    base = block_of(keys, blocks) * (DEPTH << BLOCK_LOG2)
    ok = np.ones(len(keys), bool)
    for c in cells(keys):
        c = base + c
        ok &= (bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & np.uint8(1) > 0
    return ok


def repeated_keys(parts: DataFrame) -> DataFrame:
    """(key): the keys whose cells are all counted twice or more, each once, for a sketch that is too large to send."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        count, lists = counted(pdf)
        k = np.unique(np.concatenate(lists))
        ok = np.ones(len(k), bool)
        for c in cells(k):
            ok &= count[c] > 1
        return pd.DataFrame({"key": k[ok].view(np.int64)})

    return parts.groupBy("block").applyInPandas(merge, "key long").select(F.col("key"))
