"""Exact Jaccard self-join of texts' shingle sets, as components of links.

The join works in the metric space of sets. Documents are first dealt to the
regions of their rarest shingles: two sets as similar as asked share one of
each other's ``n - ceil(t n) + 1`` rarest, so both lie in its region. (Random
pivots alone cannot make this first cut: unrelated texts are all at a distance
near 1 from any pivot, see README.) A region too large to be joined outright
is cut by pivots: each set goes to the Voronoi cell of its nearest pivot, and
also to every cell whose pivot is farther by no more than twice the largest
distance of a link, which by the triangle inequality brings both ends of each
link into one cell. Cells are cut again in the same way until they are small;
a region that a cut would not halve is left as it was and joined block against
block. Before that, every set is verified against the nearest of its regions'
pivots only, the sets that most documents have, which unites most groups of
copies; a region whose sets are all united has nothing left to join.

Distances inside regions are those of parity sketches. They never exceed the
sets' symmetric difference, so no link is lost; the pairs that pass are
verified on the whole shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.llm.arrow import batches_of, chunks, joined_chunks
from martlens.llm.components import components
from martlens.llm.membership import bloom_of
from martlens.llm.store import ship, unused, written
from martlens.llm.words import parity_sketch, set_hash, shingle_sets

#: A sketch has about as many bits as its set has shingles, within these bounds.
LEAST_BITS, MOST_BITS = 256, 1 << 15
COUNTERS = 1 << 20
_CHUNK = 1 << 12
#: Largest region joined outright, pivots per cut, and how often a region is cut.
LEAF, PIVOTS, DEPTH = 2048, 8, 4
#: A cut stands if its cells have at most this share of the region's pairs.
WORTH = 0.5
#: Rounds in which a set meets only its nearest pivot.
PIVOT_ROUNDS = 1
#: Sets that a task remembers, so as to pass copies over.
_SEEN = 1 << 16
#: Untested pairs that a set proposes besides a region's forest, round by round.
PROPOSALS = (4, 64, 1 << 30)
#: Texts whose sets a task holds at once, rows of regions whose pairs it holds at
#: once (or one region), and pairs that it walks through at once.
_SLICE, _HELD, _WALK = 512, 2048, 1 << 16
_SCAN = (
    "kind int, doc_id long, text_hash long, n long, h long, sketch binary, chunk int, bits binary"
)
_ROW = "home long, region long, side int, h long, n long, comp long"
_FOUND = "a long, b long, home long"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            yield batch.slice(at, _SLICE)


def _scan(docs: DataFrame, width: int) -> DataFrame:
    """Per document (kind 0) its set's size, hash and sketch; per task (kind 1)
    counts of all its documents' shingles by hash class."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(COUNTERS, np.int64)
        for batch in _slices(batches):
            rows, held, size = [], [], 0
            texts = (text.as_py() for text in batch.column(1))
            known = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)
            for names, found in zip(known, shingle_sets(texts, width), strict=True):
                sketch = parity_sketch(found, _bits(len(found))) if len(found) else None
                rows.append((0, *names, len(found), set_hash(found), sketch, None, None))
                held.append(found & np.uint64(COUNTERS - 1))
                size += len(found)
                if size > 1 << 20:
                    totals += np.bincount(np.concatenate(held).astype(np.int64), minlength=COUNTERS)
                    held, size = [], 0
            if held:
                totals += np.bincount(np.concatenate(held).astype(np.int64), minlength=COUNTERS)
            yield from batches_of(_SCAN, rows)
        parts = [(1, None, None, None, None, None, i, data) for i, data in chunks(totals, _CHUNK)]
        yield from batches_of(_SCAN, parts)

    given = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return given.mapInArrow(read, _SCAN)


def _bits(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (n - 1).bit_length()))


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """Rows of sketches at a smaller width: the same sets' sketches of fewer bits."""
    while sketch.shape[-1] > words:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of one byte; 0 is rarest."""
    return np.minimum(255, np.floor(8 * np.log2(1.0 + counts))).astype(np.uint8)


def _rarest(docs: DataFrame, width: int, percent: int, levels) -> DataFrame:
    """(sig, h): each set's rarest shingles, enough to meet every linked set.

    Rarity only orders shingles; any order gives the same links. A task passes
    over copies that it remembers; the rest of the copies go later.
    """
    schema = "sig long, h long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = levels.value
        seen: set[int] = set()
        for batch in _slices(batches):
            sigs, hashes = [], []
            for found in shingle_sets((text.as_py() for text in batch.column(0)), width):
                n = len(found)
                if n and (h := set_hash(found)) not in seen:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(h)
                    level = rank[(found & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64)
                    order = np.argsort((level << np.uint64(56)) | (found >> np.uint64(8)), kind="stable")
                    least = n - (percent * n + 99) // 100 + 1
                    sigs.append(found[order[:least]].view(np.int64))
                    hashes.append(np.full(least, h))
            if sigs:
                columns = [pa.array(np.concatenate(x)) for x in (sigs, hashes)]
                yield pa.RecordBatch.from_arrays(columns, ["sig", "h"])

    return docs.select("text").mapInArrow(read, schema)


def _regions(rarest: DataFrame, classes: DataFrame, percent: int, leaf: int) -> DataFrame:
    """(region, h, n, copies): the sets that share a rare shingle.

    A region of more than ``leaf`` sets is split by size: sets that can be
    linked are of one class of sizes or of neighbouring ones. Near copies share
    many rare shingles, so of regions of the same sets one stays.
    """
    met = rarest.groupBy("sig").agg(
        F.min("h").alias("low"), F.max("h").alias("high"), F.count(F.lit(1)).alias("size")
    )
    met = written(met.where("low <> high").select("sig", "size"), "met")
    members = rarest.join(met, "sig").distinct().join(classes.select("h", "n", "copies"), "h")
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(1.0001 * 100 / percent))
    regions = F.when(F.col("size") <= leaf, F.array(F.xxhash64("sig"))).otherwise(
        F.array(F.xxhash64("sig", size_class), F.xxhash64("sig", size_class + 1))
    )
    members = written(members.select(F.explode(regions).alias("region"), "h", "n", "copies"), "members")
    same = members.groupBy("region").agg(
        F.count(F.lit(1)).alias("size"),
        F.min("h").alias("low"),
        F.max("h").alias("high"),
        *[F.bit_xor(F.xxhash64("h", F.lit(i))).alias(f"x{i}") for i in range(2)],
    )
    once = same.where("low <> high").groupBy("size", "low", "high", "x0", "x1")
    once = once.agg(F.min("region").alias("region")).select("region")
    return written(members.join(once, "region", "left_semi"), "regions")


def _to_pivots(rows: DataFrame, sketches: DataFrame, tested: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) of a set and the nearest pivot of its regions that it may be linked to.

    A region's pivot is the set that most documents have, since near copies are
    mostly copies of that one, and of such sets the one that comes first by a
    hash, another one each turn; regions of the same copies so have the same
    pivot. Pivots of the set's own component and pairs tested before are left out.
    """
    schema = "h long, p long, far double"
    first = F.struct((-F.col("copies")).alias("few"), F.xxhash64("h", F.lit(turn)).alias("x"), "h")
    pivot = F.struct(F.col("h").alias("p"), F.col("n").alias("pn"), F.col("comp").alias("pcomp"))
    pivots = rows.groupBy("region").agg(F.min_by(pivot, first).alias("pivot")).select("region", "pivot.*")
    met = rows.join(pivots, "region").where("comp <> pcomp")
    met = met.where(100 * F.least("n", "pn") >= percent * F.greatest("n", "pn"))
    met = met.select("h", "p", "n", "pn").distinct()
    met = met.withColumns({"a": F.least("h", "p"), "b": F.greatest("h", "p")})
    met = met.join(tested.select("a", "b"), ["a", "b"], "left_anti")
    met = met.join(sketches, "h").join(
        sketches.select(F.col("h").alias("p"), F.col("sketch").alias("ps")), "p"
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            shapes: dict[tuple[int, int], list[int]] = {}
            for i, key in enumerate(zip(map(len, x), map(len, y), strict=True)):
                shapes.setdefault(key, []).append(i)
            differ = np.zeros(len(x), np.int64)
            for (wide_x, wide_y), rows in shapes.items():
                words = min(wide_x, wide_y) // 8
                left = np.frombuffer(b"".join(x[i] for i in rows), np.uint64).reshape(len(rows), -1)
                right = np.frombuffer(b"".join(y[i] for i in rows), np.uint64).reshape(len(rows), -1)
                bits = _folded(left, words) ^ _folded(right, words)
                differ[rows] = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
            ok = np.flatnonzero(differ * (100 + percent) <= sizes * (100 - percent))
            if len(ok):
                ids = [batch.column(i).take(pa.array(ok)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(differ[ok] / sizes[ok])], ["h", "p", "far"])

    near = met.select("h", "p", "n", "pn", "sketch", "ps").mapInArrow(measure, schema)
    nearest = near.groupBy("h").agg(F.min_by("p", F.struct("far", "p")).alias("p"))
    return nearest.select(F.least("h", "p").alias("a"), F.greatest("h", "p").alias("b")).distinct()


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Whole regions from batches sorted by region, as few at a time as make ``_HELD``
    rows; only the last one is carried on."""
    carried: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([carried, table]) if carried is not None else table
        regions = table.column("region").to_numpy()
        cut = int(np.searchsorted(regions, regions[-1], "left")) if len(regions) else 0
        carried = table.slice(cut)
        at = 0
        while at < cut:
            # The region that the last of these rows is in is taken whole.
            last = regions[min(at + _HELD, cut) - 1]
            end = int(np.searchsorted(regions, last, "right"))
            yield table.slice(at, end - at)
            at = end
    if carried is not None and carried.num_rows:
        yield carried


def _propose(
    rows: DataFrame, sketches: DataFrame, tested: DataFrame, percent: int, most: int
) -> DataFrame:
    """Untested pairs (a, b) of a region, of different components, that may be linked.

    Rows without a pair name, as ``home``, the regions whose pairs are not all proposed.

    Every two rows of a region meet. A pair passes if the sizes and sketches
    allow a link. Of the pairs that pass, the nearest ones are proposed: those
    that join two components not yet joined by a nearer proposal, and up to
    ``most`` more per set.
    """

    def near(table: pa.Table) -> list[tuple[int | None, int | None, int | None]]:
        home, region, side, h, n, comp = (
            table.column(name).to_numpy() for name in ("home", "region", "side", "h", "n", "comp")
        )
        data = table.column("sketch").to_pylist()
        words = np.array([len(x) // 8 for x in data])
        # Sizes of a pair are alike, so its sketches are of one width or of neighbouring ones.
        at_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in np.unique(words).tolist():
            place, parts = np.full(len(h), -1), []
            for wide in (width, 2 * width):
                rows = np.flatnonzero(words == wide)
                place[rows] = np.arange(len(rows)) + sum(map(len, parts))
                joined = np.frombuffer(b"".join(data[i] for i in rows), np.uint64)
                parts.append(_folded(joined.reshape(len(rows), wide), width))
            at_width[width] = place, np.concatenate(parts)

        def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out, least = np.zeros(len(x), np.int64), np.minimum(words[x], words[y])
            for width in np.unique(least).tolist():
                these = least == width
                place, sketch = at_width[width]
                differ = sketch[place[x[these]]] ^ sketch[place[y[these]]]
                out[these] = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
            return out

        tested = [set(x or ()) for x in table.column("tested").to_pylist()]
        found = []
        at, gap = np.arange(len(h) - 1), 1
        while len(at):
            at = at[at + gap < len(h)]
            at = at[region[at] == region[at + gap]]
            a, b = at, at + gap
            meet = (side[a] == 0) | (side[a] != side[b])
            low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
            meet &= (comp[a] != comp[b]) & (100 * low >= percent * high)
            a, b = a[meet], b[meet]
            for i in range(0, len(a), 1 << 13):
                x, y = a[i : i + (1 << 13)], b[i : i + (1 << 13)]
                differ = distance(x, y)
                ok = differ * (100 + percent) <= (n[x] + n[y]) * (100 - percent)
                found.append(np.stack([x[ok], y[ok], differ[ok]]).astype(np.int32))
            gap += 1
        if not found:
            return []
        x, y, differ = np.concatenate(found, axis=1)
        order = np.argsort(differ / (n[x] + n[y]), kind="stable")
        walk = (order[i : i + _WALK] for i in range(0, len(order), _WALK))
        root: dict[tuple, int] = {}

        def top(node: tuple) -> tuple:
            while root.get(node, node) != node:
                node = root[node]
            return node

        used = np.zeros(len(h), np.int64)
        out: list[tuple[int | None, int | None, int | None]] = []
        unfinished: set[int] = set()
        for i, j in (pair for w in walk for pair in zip(x[w].tolist(), y[w].tolist(), strict=True)):
            if h[j] in tested[i]:
                continue
            p, q = top((region[i], comp[i])), top((region[j], comp[j]))
            if p != q:
                root[p] = q
            elif used[i] >= most or used[j] >= most:
                unfinished.add(int(home[i]))
                continue
            used[i] += 1
            used[j] += 1
            out.append((int(min(h[i], h[j])), int(max(h[i], h[j])), None))
        return out + [(None, None, x) for x in unfinished]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _rows_of(batches):
            yield from batches_of(_FOUND, near(table))

    both = tested.where("not linked").select(F.col("a").alias("h"), F.col("b").alias("other"))
    both = both.unionByName(both.select(F.col("other").alias("h"), F.col("h").alias("other")))
    known = both.groupBy("h").agg(F.collect_list("other").alias("tested"))
    rows = rows.join(sketches, "h").join(known, "h", "left")
    dealt = rows.repartition("region").sortWithinPartitions("region", "side", "h")
    return dealt.mapInArrow(read, _FOUND).distinct()


def _cut(rows: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Voronoi cells of regions' pivots, with the boundary sets of other cells.

    ``parent`` and ``size`` are the region that was cut and its rows. A region's pivots are the sets that come first by a hash, one per class of
    sets, found by an aggregate. A set of ``n`` shingles differs from a linked
    one in at most ``(100 - p) / p * n``.
    """
    schema = _ROW.replace("region long", "region long, cell int") + ", size long"
    columns = [*(part.split()[0] for part in _ROW.split(", ")), "size"]
    rows = rows.join(sketches, "h")
    salted = rows.groupBy("region", F.pmod(F.xxhash64("h"), F.lit(PIVOTS)).alias("class")).agg(
        F.min_by("sketch", F.struct(F.xxhash64("region", "h"), "h")).alias("sketch")
    )
    pivots = salted.groupBy("region").agg(F.sort_array(F.collect_list("sketch")).alias("pivots"))
    widths = rows.groupBy("region").agg((F.min(F.length("sketch")) / 8).cast("int").alias("words"))
    pivots = pivots.join(widths, "region")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sizes, words = table.column("n").to_numpy(), table.column("words").to_pylist()
            out, cells = [], []
            for i, (sketch, pivots) in enumerate(
                zip(table.column("sketch").to_pylist(), table.column("pivots").to_pylist(), strict=True)
            ):
                own = _folded(np.frombuffer(sketch, np.uint64), words[i])
                others = [_folded(np.frombuffer(p, np.uint64), words[i]) for p in pivots]
                far = np.array([int(np.bitwise_count(own ^ other).sum()) for other in others])
                window = 2 * ((100 - percent) * int(sizes[i]) // percent)
                for cell in np.flatnonzero(far <= far.min() + window).tolist():
                    out.append(i)
                    cells.append(cell)
            taken = table.select(columns).take(pa.array(out, pa.int64()))
            taken = taken.add_column(2, "cell", pa.array(cells, pa.int32()))
            yield from taken.combine_chunks().to_batches()

    cut = rows.join(pivots, "region").select(*columns, "sketch", "pivots", "words")
    cut = cut.mapInArrow(read, schema)
    return cut.withColumns(
        {"parent": F.col("region"), "region": F.xxhash64("region", "cell")}
    ).drop("cell")


def _sizes(rows: DataFrame) -> DataFrame:
    stats = rows.groupBy("region").agg(
        F.count(F.lit(1)).alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")
    )
    return stats.where("low <> high").select("region", "size")


def _small_regions(rows: DataFrame, sketches: DataFrame, percent: int, leaf: int) -> DataFrame:
    """The same meetings in regions of about ``leaf`` rows.

    A set is in each cell whose window it is in, so a cut can also make more
    rows and no fewer pairs. Such a region goes into blocks as it was.
    """
    done: list[DataFrame] = []
    stuck: list[DataFrame] = []
    for _ in range(DEPTH):
        sized = written(rows.join(_sizes(rows), "region"), "regions")
        done.append(sized.where(F.col("size") <= leaf).drop("size"))
        large = sized.where(F.col("size") > leaf)
        if large.isEmpty():
            break
        cells = written(_cut(large, sketches, percent), "cells")
        held = cells.groupBy("parent", "size", "region").agg(F.count(F.lit(1)).alias("rows"))
        pairs = held.groupBy("parent", "size").agg(F.sum(F.col("rows") * F.col("rows")).alias("pairs"))
        worth = pairs.where(F.col("pairs") <= WORTH * F.col("size") * F.col("size")).select("parent")
        stuck.append(large.join(worth, F.col("region") == F.col("parent"), "left_anti"))
        rows = cells.join(worth, "parent").drop("parent", "size")
    else:
        stuck.append(rows.join(_sizes(rows), "region").select(*large.columns))
    if stuck:
        rows = stuck[0]
        for more in stuck[1:]:
            rows = rows.unionByName(more)
        blocks = F.ceil(F.col("size") * 2 / leaf)
        own = F.pmod(F.xxhash64("h", "region"), blocks)
        others = F.sequence(F.lit(0).cast("long"), blocks - 1)
        pairs = F.transform(
            others, lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j"))
        )
        blocked = rows.withColumn("own", own).withColumn("pair", F.explode(pairs))
        done.append(
            blocked.withColumn("region", F.xxhash64("region", "pair.i", "pair.j"))
            .withColumn(
                "side",
                F.when(F.col("pair.i") == F.col("pair.j"), 0)
                .when(F.col("own") == F.col("pair.i"), 1)
                .otherwise(2),
            )
            .drop("own", "pair", "size")
        )
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, linked) on the whole shingle sets of the pairs' documents."""
    schema = "doc_id long, h long, found array<long>"
    ends = pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).distinct()
    wanted = ends.join(classes.select("h", "rep"), "h").select("rep")
    hashed = docs.sparkSession.sparkContext.broadcast(bloom_of(wanted.select(F.xxhash64("rep").alias("k"))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            hit = hashed.value.test(batch.column(2).to_numpy())
            rows = []
            batch = batch.filter(pa.array(hit))
            texts = (text.as_py() for text in batch.column(1))
            for doc, found in zip(batch.column(0).to_pylist(), shingle_sets(texts, width), strict=True):
                if len(found):
                    rows.append((doc, set_hash(found), found.view(np.int64)))
            yield from batches_of(schema, rows)

    sets = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("k")).mapInArrow(read, schema)
    sets = sets.join(ends, "h").groupBy("h").agg(F.first("found").alias("found"))
    left = sets.select(F.col("h").alias("a"), F.col("found").alias("x"))
    right = sets.select(F.col("h").alias("b"), F.col("found").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    return (
        pairs.join(left, "a").join(right, "b").select("a", "b", (100 * common >= percent * union).alias("linked"))
    )


def _united(docs: DataFrame, width: int, percent: int, leaf: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n, h) of every document, and (h, rep, root) of every set.

    Each round proposes pairs, first those of sets and their nearest pivots
    and then those of whole regions, verifies them and unites their components;
    regions whose sets are all in one component are finished. A pair found
    not to be linked is not proposed again, a region all of whose pairs that
    could be linked have been proposed is done, and rounds end when every
    region is, so the components are exact.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    scanned = written(_scan(docs, width), "sets")
    counts = scanned.where("kind = 1")
    levels = joined_chunks(counts, "<i8", _CHUNK, COUNTERS, np.add, _levels)
    sets = scanned.where("kind = 0 and n > 0")
    copies = F.count(F.lit(1)).alias("copies")
    classes = written(sets.groupBy("h", "n").agg(F.min("doc_id").alias("rep"), copies), "classes")
    rarest = written(_rarest(docs, width, percent, spark.sparkContext.broadcast(levels)), "rarest")
    members = _regions(rarest, classes, percent, leaf)
    sketches = sets.join(members.select("h").distinct(), "h", "left_semi")
    sketches = written(sketches.groupBy("h").agg(F.min("sketch").alias("sketch")), "sketches")

    tested = spark.createDataFrame([], "a long, b long, linked boolean")
    roots = spark.createDataFrame([], "node long, root long")
    turn = 0
    while True:
        labelled = members.join(roots, F.col("h") == F.col("node"), "left").withColumn(
            "comp", F.coalesce("root", "h")
        )
        rows = labelled.join(_sizes(labelled).select("region"), "region")
        rows = rows.select("region", "h", "n", "copies", "comp")
        if turn < PIVOT_ROUNDS:
            pairs = written(_to_pivots(rows, sketches, tested, percent, turn), "nearest-pivots")
        else:
            rows = rows.select(F.col("region").alias("home"), "region", F.lit(0).alias("side"), "h", "n", "comp")
            most = PROPOSALS[min(turn - PIVOT_ROUNDS, len(PROPOSALS) - 1)]
            cells = _small_regions(rows, sketches, percent, leaf)
            found = written(_propose(cells, sketches, tested, percent, most), "proposed")
            pairs = found.where("home is null").select("a", "b")
            unfinished = found.where("home is not null").select(F.col("home").alias("region")).distinct()
            members = members.join(unfinished, "region")
        turn += 1
        if not pairs.isEmpty():
            now = written(_verify(pairs, docs, classes, width, percent), "verified")
            tested = tested.unionByName(now)
            links = tested.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
            roots = components(links)
        if turn > PIVOT_ROUNDS and members.isEmpty():
            break
    named = classes.join(roots, F.col("h") == F.col("node"), "left").withColumn(
        "root", F.coalesce("root", "h")
    )
    every = scanned.where("kind = 0").select("doc_id", "text_hash", "n", "h")
    return every, named.select("h", "rep", "root")


def jaccard_components(
    docs: DataFrame, width: int = 5, percent: int = 80, leaf: int = LEAF
) -> DataFrame:
    """Components of documents (doc_id, text) linked by similar shingle sets.

    Two documents link when the Jaccard similarity of their sets of
    ``width``-word shingles is at least ``percent`` hundredths. One row per
    document: doc_id, n_shingles, component_id (the smallest doc_id reachable
    by links, its own included). A document without words (or text) has no
    shingles, no link, and its own id. Equal sets are one set with one
    representative. Rows of equal doc_id are joined like others; a null doc_id
    takes part, but names a component only if no other id is in it. No
    documents, no rows. Other columns are not read. Only components are
    computed: pairs inside a part that is already united are not verified, so
    links and their number are not known.
    """
    every, named = _united(docs, width, percent, leaf)
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select("h", "component_id")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return every.join(named, "h", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, leaf: int = LEAF) -> DataFrame:
    """``docs`` with one document of each component, in all its columns.

    The one with the smallest doc_id stays (a null id last; among equal ids
    that of least text hash). Documents without words all stay.
    """
    every, named = _united(docs, width, percent, leaf)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("w")
    winners = every.where("n > 0").join(named, "h").groupBy("root").agg(first)
    key, winner = unused(docs, "_key"), unused(docs, "_winner")
    winners = winners.select(F.xxhash64("w.doc_id", "w.text_hash").alias(winner))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.xxhash64("text")))
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = keyed.where(has_words).join(winners, F.col(key) == F.col(winner), "left_semi")
    kept = kept.dropDuplicates([key])
    return kept.unionByName(keyed.where(~has_words)).drop(key)
