"""Token ids in binary shard files, compressed by a grammar of id pairs.

A shard file, little-endian: the magic ``RPS1``; documents, rules, symbols and
ids as unsigned 64-bit counts, then the first rule's symbol and the bytes per
symbol (2 or 4) as unsigned 32-bit; per rule its two symbols (32-bit each);
per rule its expansion length (64-bit); per document its doc_id (signed
64-bit), whether that id is null (8-bit), its ids (64-bit) and the symbol
after its last (64-bit); the symbols. A rule's symbols are ids or earlier
rules. No rule spans two documents, so that a document's symbols stand alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlens.llm.store import new_path, ship
from martlens.llm.tokens import WordEncoder

END_ID = 2
_HEAD = struct.Struct("<4s4Q2I")
#: Rounds end when one replaces a smaller part of the symbols than this.
_LEAST_GAIN = 0.01
_LEAST_COUNT = 8
_PER_ROUND = 4096


def _chosen(pairs: np.ndarray, counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """The most frequent pairs in which no symbol is a left and a right part.

    So occurrences of chosen pairs never overlap. A pair of equal symbols is
    chosen if its symbol is in no other pair.
    """
    top = np.flatnonzero(counts >= _LEAST_COUNT)
    if len(top) > 4 * _PER_ROUND:
        top = top[np.argpartition(counts[top], -4 * _PER_ROUND)[-4 * _PER_ROUND :]]
    top = top[np.lexsort((pairs[top], -counts[top]))]
    lefts, rights, doubled, found = set(), set(), set(), []
    for pair in pairs[top].tolist():
        a, b = pair >> 32, pair & 0xFFFFFFFF
        if a == b:
            if a in lefts or a in rights or a in doubled:
                continue
            doubled.add(a)
        elif a in rights or b in lefts or a in doubled or b in doubled:
            continue
        else:
            lefts.add(a)
            rights.add(b)
        found.append((a, b))
        if len(found) >= min(room, _PER_ROUND):
            break
    return found


def _replace(
    symbols: np.ndarray, last: np.ndarray, rules: list[tuple[int, int]], first: int
) -> tuple[np.ndarray, np.ndarray]:
    """Put ``first + i`` for each occurrence of ``rules[i]``."""
    size = max(int(symbols.max()) + 1, first)
    left_of, right_of = np.zeros(size, np.int32), np.zeros(size, np.int32)
    lefts = {a: i + 1 for i, a in enumerate(dict.fromkeys(a for a, _ in rules))}
    rights = {b: i + 1 for i, b in enumerate(dict.fromkeys(b for _, b in rules))}
    left_of[list(lefts)] = list(lefts.values())
    right_of[list(rights)] = list(rights.values())
    number = np.zeros((len(lefts) + 1, len(rights) + 1), np.int32)
    for i, (a, b) in enumerate(rules):
        number[lefts[a], rights[b]] = i + 1
    at = np.flatnonzero((left_of[symbols[:-1]] > 0) & (right_of[symbols[1:]] > 0) & ~last[:-1])
    rule = number[left_of[symbols[at]], right_of[symbols[at + 1]]]
    at, rule = at[rule > 0], rule[rule > 0]
    same = symbols[at] == symbols[at + 1]
    if same.any():  # of a run of equal symbols every other place starts a pair
        runs = at[same]
        fresh = np.concatenate([[True], (np.diff(runs) != 1) | (np.diff(symbols[runs]) != 0)])
        begun = np.maximum.accumulate(np.where(fresh, np.arange(len(runs)), 0))
        keep = np.ones(len(at), bool)
        keep[np.flatnonzero(same)[(np.arange(len(runs)) - begun) % 2 == 1]] = False
        at, rule = at[keep], rule[keep]
    symbols, last = symbols.copy(), last.copy()
    symbols[at] = first + rule - 1
    last[at] = last[at + 1]
    stay = np.ones(len(symbols), bool)
    stay[at + 1] = False
    return symbols[stay], last[stay]


def compress(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols, the symbol after each document, rules and the first rule's symbol.

    ``ends`` is the id after each document; no document is empty. Each round
    counts all adjacent pairs of the shard and replaces many frequent ones at
    once. Symbols stay below 65,536 where the ids do.
    """
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(symbols), bool)
    last[ends - 1] = True
    first = int(symbols.max()) + 1 if len(symbols) else 0
    space = (1 << 16 if first < 1 << 16 else 1 << 31) - first
    rules: list[tuple[int, int]] = []
    while len(symbols) > 1 and len(rules) < space:
        inside = ~last[:-1]
        keys = (symbols[:-1][inside].astype(np.uint64) << np.uint64(32)) | symbols[1:][inside]
        keys.sort()
        bounds = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1))) if len(keys) else keys
        counts = np.diff(np.append(bounds, len(keys)))
        found = _chosen(keys[bounds.astype(np.int64)], counts, space - len(rules))
        if not found:
            break
        before = len(symbols)
        symbols, last = _replace(symbols, last, found, first + len(rules))
        rules += found
        if before - len(symbols) < _LEAST_GAIN * before:
            break
    return symbols, np.flatnonzero(last) + 1, np.array(rules, np.uint32).reshape(-1, 2), first


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for."""
    symbols = symbols.astype(np.uint32)
    while len(symbols) and (ruled := symbols >= first).any():
        place = np.cumsum(1 + ruled) - 1 - ruled
        wider = np.empty(len(symbols) + int(ruled.sum()), np.uint32)
        wider[place] = symbols
        parts = rules[symbols[ruled] - first]
        wider[place[ruled]], wider[place[ruled] + 1] = parts[:, 0], parts[:, 1]
        symbols = wider
    return symbols


@dataclass
class Shard:
    """One shard file, opened; documents and ranges of them are decoded on demand."""

    doc_ids: list[int | None]
    totals: np.ndarray
    ends: np.ndarray
    symbols: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    first: int

    @staticmethod
    def pack(doc_ids: list[int | None], data: list[bytes]) -> bytes:
        """A shard file of documents' ids, given as 32-bit little-endian bytes."""
        ids = np.frombuffer(b"".join(data), "<u4")
        totals = np.array([len(x) // 4 for x in data], np.uint64)
        symbols, ends, rules, first = compress(ids, np.cumsum(totals).astype(np.int64))
        lengths = np.ones(len(rules), np.uint64)
        for i, (a, b) in enumerate(rules.tolist()):
            lengths[i] = sum(1 if s < first else int(lengths[s - first]) for s in (a, b))
        width = 2 if first + len(rules) <= 1 << 16 else 4
        head = _HEAD.pack(b"RPS1", len(data), len(rules), len(symbols), len(ids), first, width)
        parts = [
            rules.astype("<u4"),
            lengths.astype("<u8"),
            np.array([d or 0 for d in doc_ids], "<i8"),
            np.array([d is None for d in doc_ids], "u1"),
            totals.astype("<u8"),
            ends.astype("<u8"),
            symbols.astype(f"<u{width}"),
        ]
        return head + b"".join(part.tobytes() for part in parts)

    @staticmethod
    def open(payload: bytes) -> Shard:
        magic, n, n_rules, n_symbols, _, first, width = _HEAD.unpack_from(payload)
        if magic != b"RPS1":
            raise ValueError("not a shard file")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(payload, kind, count, at)
            at += found.nbytes
            return found

        rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        lengths = take("<u8", n_rules)
        ids, null = take("<i8", n), take("u1", n)
        totals, ends = take("<u8", n).astype(np.int64), take("<u8", n).astype(np.int64)
        doc_ids = [None if x else d for d, x in zip(ids.tolist(), null, strict=True)]
        return Shard(doc_ids, totals, ends, take(f"<u{width}", n_symbols), rules, lengths, first)

    def ids(self) -> np.ndarray:
        """All ids of the shard."""
        return expand(self.symbols, self.rules, self.first)

    def part(self, document: int, low: int, high: int) -> np.ndarray:
        """Ids ``low`` to ``high`` of a document; only the symbols there are decoded."""
        start = int(self.ends[document - 1]) if document else 0
        symbols = self.symbols[start : int(self.ends[document])].astype(np.int64)
        widths = np.ones(len(symbols), np.int64)
        ruled = symbols >= self.first
        widths[ruled] = self.lengths[symbols[ruled] - self.first]
        ends = np.cumsum(widths)
        a, b = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high, "left")
        skip = low - (int(ends[a - 1]) if a else 0)
        return expand(symbols[a : b + 1], self.rules, self.first)[skip : skip + high - low]


def write_tokens(docs: DataFrame, tokenizer: str, shard_ids: int = 1 << 21) -> str:
    """Encode whole texts and write shard files in ascending doc_id order.

    Returns the folder, in the shared one: a table (part, shard, n_ids,
    payload) whose rows are the shard files, ordered by part and shard. Parts
    are ranges of doc_id; null ids come first, and a range splits rows of
    equal id too. A shard takes documents until it has ``shard_ids`` ids; a
    longer document is a shard of its own. A null or empty text is the end id
    alone. Spark commits each file whole, so a lost executor leaves no half
    shard.
    """
    spark = docs.sparkSession
    ship(spark)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        part, number = TaskContext.get().partitionId(), 0
        held_ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([number], pa.int32()),
                    pa.array([size], pa.int64()),
                    pa.array([Shard.pack(held_ids, held)], pa.binary()),
                ],
                ["part", "shard", "n_ids", "payload"],
            )

        for batch in batches:
            texts = (text.as_py() for text in batch.column(1))
            for doc, data in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                count = len(data) // 4 + 1
                if held and size + count > shard_ids:
                    yield file()
                    number, held_ids, held, size = number + 1, [], [], 0
                held_ids.append(doc)
                held.append(data + end)
                size += count
        if held:
            yield file()

    path = new_path(spark, "token-files")
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("tie"))
    (
        rows.repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
        .mapInArrow(shards, "part int, shard int, n_ids long, payload binary")
        .write.parquet(path)
    )
    return path


def read_index(spark, path: str) -> DataFrame:
    """Decode the shard files: one row per document, from the files alone.

    doc_id, start (ids of all documents before it), n_tokens, ids_crc32.
    """
    ship(spark)
    files = spark.read.schema("part int, shard int, n_ids long, payload binary").parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, payload in zip(*(batch.column(i) for i in (0, 1, 3)), strict=True):
                shard = Shard.open(payload.as_py())
                data = memoryview(shard.ids().astype("<u4").tobytes())
                ends = np.cumsum(shard.totals)
                starts = ends - shard.totals
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(sums)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.as_py()] * n, pa.int32()),
                        pa.array([number.as_py()] * n, pa.int32()),
                        pa.array(shard.doc_ids, pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array(shard.totals, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    ["part", "shard", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    schema = "part int, shard int, doc_id long, inner long, n_tokens long, ids_crc32 long"
    documents = files.mapInArrow(decode, schema)
    sizes = files.select("part", "shard", "n_ids")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skip"))
    inside = (
        Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sizes.join(parts, "part").select(
        "part",
        "shard",
        (F.col("skip") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("skip"),
    )
    return documents.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("skip") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32"
    )
