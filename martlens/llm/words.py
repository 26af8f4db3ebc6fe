"""Words, shingles and set sketches of many texts at once, in numpy.

A word is a longest run of bytes other than space, tab, line feed, vertical
tab, form feed and carriage return, with A-Z lower-cased. Words and shingles
are 64-bit hashes, equal for equal words on any machine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U64 = np.uint64
_BLOCK = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x.astype(U64)
    with np.errstate(over="ignore"):
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def _letters() -> np.ndarray:
    codes = np.arange(256, dtype=U64)
    codes[65:91] += U64(32)
    return mix(codes + U64(0x9E3779B97F4A7C15)) | U64(1)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        steps = np.full(n, 0x9FB21C651E98DF25, U64)
        steps[0] = 1
        return np.cumprod(steps, dtype=U64)


_LETTERS = _letters()
_POWERS = _powers(1 << 12)


def word_hashes(data: bytes, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of ``data`` and the byte at which it starts.

    ``blank`` marks the bytes between words.
    """
    global _POWERS
    codes = np.frombuffer(data, np.uint8)
    inside = ~blank[codes]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, U64), starts
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(firsts[-1] + lengths[-1]) - np.repeat(firsts, lengths)
    if (longest := int(lengths.max())) > len(_POWERS):
        _POWERS = _powers(longest)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(_LETTERS[codes[inside]] * _POWERS[place], firsts)
        return mix(sums + lengths.astype(U64)), starts


def _segments(data: bytes, blank: np.ndarray = _BLANK) -> Iterator[bytes]:
    """Parts of about a megabyte, cut at blanks, so that arrays stay small."""
    at = 0
    while len(data) - at > 2 * _BLOCK:
        cut = at + _BLOCK
        while cut < len(data) and not blank[data[cut]]:
            cut += 1
        yield data[at:cut]
        at = cut
    yield data[at:]


def _blocks(texts: Iterable[str | None]) -> Iterator[list[bytes]]:
    """Runs of texts of about a megabyte in all; a longer text is alone."""
    block: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if block and size + len(data) > _BLOCK:
            yield block
            block, size = [], 0
        block.append(data)
        size += len(data)
    if block:
        yield block


def shingle_sets(texts: Iterable[str | None], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    A text with fewer words has one shingle, all its words; one without words
    (or a null text) has none.
    """
    factors = mix(np.arange(1, width + 1, dtype=U64)) | U64(1)
    for block in _blocks(texts):
        if len(block) == 1:
            words = np.concatenate([word_hashes(part)[0] for part in _segments(block[0])])
            bounds = np.array([0, len(words)])
        else:
            words, starts = word_hashes(b"\n".join(block))
            ends = np.cumsum([len(data) + 1 for data in block])
            bounds = np.concatenate([[0], np.searchsorted(starts, ends)])
        with np.errstate(over="ignore"):
            n = max(0, len(words) - width + 1)
            sums = np.zeros(n, U64)
            for i in range(width):
                sums += words[i : i + n] * factors[i]
            runs = mix(sums)
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                if high - low >= width:
                    found = np.sort(runs[low : high - width + 1])
                    yield found[np.diff(found, prepend=~found[:1]) != 0]
                elif high > low:
                    short = (words[low:high] * factors[: high - low]).sum(dtype=U64)
                    yield mix(np.array([short + U64(high - low)], U64))
                else:
                    yield np.zeros(0, U64)


def set_hash(shingles: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed integer."""
    with np.errstate(over="ignore"):
        total = mix(shingles + U64(1)).sum(dtype=U64) + U64(len(shingles))
    return int(mix(np.array([total], U64)).view(np.int64)[0])


def parity_sketch(shingles: np.ndarray, bits: int) -> bytes:
    """One bit per class of shingles: whether it holds an odd number of them.

    Two sets' sketches differ in at most as many bits as the sets differ in
    shingles, so the distance of sketches is a lower bound.
    """
    counts = np.bincount((shingles >> U64(20)).astype(np.int64) & (bits - 1), minlength=bits)
    return np.packbits(counts & 1).tobytes()
