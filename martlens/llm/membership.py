"""A blocked Bloom filter over 64-bit hashes, of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from martlens.llm.arrow import batches_of, chunks, joined_chunks
from martlens.llm.store import ship
from martlens.llm.words import U64, mix

WORDS = 8
_CHUNK_BLOCKS = 1 << 9
#: One odd factor per word of a block.
_FACTORS = mix(np.arange(101, 101 + WORDS, dtype=U64)) | U64(1)


class BlockedBloom:
    """Blocks of eight 64-bit words, one cache line; a key sets a bit in each."""

    def __init__(self, blocks: int, bits: np.ndarray | None = None) -> None:
        self.blocks = blocks
        self.bits = np.zeros((blocks, WORDS), U64) if bits is None else bits.reshape(blocks, WORDS)

    @staticmethod
    def blocks_for(keys: int, most_bytes: int) -> int:
        """About 16 bits per key, a power of two, and no more than the bound."""
        least = _CHUNK_BLOCKS
        wanted = max(least, keys * 16 // 512)
        most = max(least, most_bytes // 64)
        return 1 << min((wanted - 1).bit_length(), most.bit_length() - 1)

    def _place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = mix(np.ascontiguousarray(hashes).view(U64))
        with np.errstate(over="ignore"):
            bit = (keys[:, None] * _FACTORS[None, :]) >> U64(58)
        return (keys & U64(self.blocks - 1)).astype(np.int64), U64(1) << bit

    def add(self, hashes: np.ndarray) -> None:
        block, masks = self._place(hashes)
        np.bitwise_or.at(self.bits, block, masks)

    def test(self, hashes: np.ndarray) -> np.ndarray:
        """False means that the key was not added; true, that it may have been."""
        if not len(hashes):
            return np.zeros(0, bool)
        block, masks = self._place(hashes)
        return ((self.bits[block] & masks) == masks).all(axis=1)


def bloom_of(keys: DataFrame, most_bytes: int = 4 << 20) -> BlockedBloom:
    """The filter of a one-column table of 64-bit keys, built by its tasks.

    Tasks fill filters of the one size, which are united part by part; null
    keys are left out. Past the bound the filter gets less selective, never
    wrong.
    """
    ship(keys.sparkSession)
    column = keys.columns[0]
    blocks = BlockedBloom.blocks_for(keys.count(), most_bytes)
    size = _CHUNK_BLOCKS * WORDS

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = BlockedBloom(blocks)
        for batch in batches:
            part.add(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
        yield from batches_of("chunk int, bits binary", chunks(part.bits.ravel(), size))

    parts = keys.select(column).mapInArrow(fill, "chunk int, bits binary")
    return BlockedBloom(
        blocks, joined_chunks(parts, "u8", size, blocks * WORDS, np.bitwise_or)
    )
