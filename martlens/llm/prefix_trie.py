"""The trie of turn prefixes of conversations that are spliced from stored turns.

A rebuilt conversation is the head of a base conversation and its own turns
after that head. Its texts are never put together. A turn is an affine map of
residues, a sequence of turns the product of their maps, and products compose:
the fingerprint of a rebuilt prefix is the base's head product times the
product of the own turns after the head. Turns stay where they are stored and
are known by reference (conversation, place).

Every row of this module is a few numbers; only the first pass and the check of
equality read texts. Fingerprints prove nothing, so each group of equal ones is
checked: same last turn, same group one turn before. Last turns that are the same
stored turn are equal; others are compared by their text. A group that fails has
everything fingerprinted anew, from another seed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.llm.store import ship, written

#: Residues are modulo this prime, so that the product of two fits a long.
PRIME = (1 << 31) - 1
_LOW = (1 << 31) - 1
_NO_IDS = hashlib.sha256(b"").hexdigest()
#: The product of no turns: the map x -> 1 x + 0, packed.
EMPTY = 1 << 31

# A map x -> m x + a is packed as m * 2^31 + a. A fingerprint is two maps
# (lanes), each made from its own 64-bit hash of the turn.
_LANES = ("1", "2")


def _parts(packed: Column) -> tuple[Column, Column]:
    return F.shiftright(packed, 31), packed.bitwiseAND(F.lit(_LOW))


def _packed(m: Column, a: Column) -> Column:
    return F.shiftleft(m, 31).bitwiseOR(a)


def _then(first: Column, second: Column) -> Column:
    """The product of two packed maps: ``first``, and ``second`` after it."""
    (m, a), (n, b) = _parts(first), _parts(second)
    return _packed((m * n) % PRIME, (a * n + b) % PRIME)


def _undone(packed: Column) -> Column:
    """The inverse of a packed map; by Fermat, m to the power p - 2 inverts m."""
    m, a = _parts(packed)
    bits = F.array(*[F.lit((PRIME - 2) >> i & 1) for i in range(31)])
    start = F.struct(F.lit(1).cast("long").alias("r"), m.alias("s"))

    def step(at: Column, bit: Column) -> Column:
        grown = F.when(bit == 1, (at["r"] * at["s"]) % PRIME).otherwise(at["r"])
        return F.struct(grown.alias("r"), ((at["s"] * at["s"]) % PRIME).alias("s"))

    inverse = F.aggregate(bits, start, step, lambda at: at["r"])
    return _packed(inverse, (PRIME - a * inverse % PRIME) % PRIME)


def _scan(maps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running products of packed maps; ``first`` says at which place of its run a row is.

    Doubling: after step s each row holds the product of up to 2s rows.
    """
    m, a = maps >> 31, maps & _LOW
    step, longest = 1, int(first.max(initial=0))
    while step <= longest:
        at = np.flatnonzero(first >= step)
        before = at - step
        new_a = (a[before] * m[at] + a[at]) % PRIME
        new_m = (m[before] * m[at]) % PRIME
        m[at], a[at] = new_m, new_a
        step *= 2
    return m << 31 | a


def _product(first: int, second: np.ndarray) -> np.ndarray:
    m, a, n, b = first >> 31, first & _LOW, second >> 31, second & _LOW
    return (m * n % PRIME) << 31 | (a * n + b) % PRIME


def _turn_maps(hashes: np.ndarray) -> np.ndarray:
    """A map for each 64-bit hash of a turn; its factor is never zero."""
    bits = hashes.view(np.uint64)
    m = (bits >> np.uint64(32)) % np.uint64(PRIME - 1) + np.uint64(1)
    a = (bits & np.uint64(0xFFFFFFFF)) % np.uint64(PRIME)
    return (m << np.uint64(31) | a).view(np.int64)


_TURNS = (
    "conv long, part int, local long, t1 long, t2 long, n long, "
    "f1 long, f2 long, e1 long, e2 long, x long"
)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places, running products and running text lengths within one task's rows.

    Takes rows ordered by conversation and turn, and holds one batch and the
    last row before it.
    """
    part = TaskContext.get().partitionId()
    conv, place, length, maps = None, 0, 0, [EMPTY, EMPTY]
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, t1, t2, n = (batch.column(i).to_numpy() for i in range(4))
        starts = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1 if conv is None else conv) != 0)
        carried = starts[0] if len(starts) else len(ids)  # rows of the run begun before
        of_run = np.zeros(len(ids), np.int64)
        of_run[starts] = starts
        local = np.arange(len(ids)) - np.maximum.accumulate(of_run)
        sums = np.cumsum(n)
        x = sums - np.maximum.accumulate(np.where(local == 0, sums - n, 0))
        products = [_scan(_turn_maps(t), local) for t in (t1, t2)]
        first, local = local == 0, local + 1
        if carried:
            local[:carried] += place
            x[:carried] += length
            for lane in range(2):
                products[lane][:carried] = _product(maps[lane], products[lane][:carried])
        before = [np.concatenate([[m], p[:-1]]) for m, p in zip(maps, products, strict=True)]
        for lane in before:
            lane[carried:][first[carried:]] = EMPTY
        conv, place, length = int(ids[-1]), int(local[-1]), int(x[-1])
        maps = [int(p[-1]) for p in products]
        columns = [ids, np.full(len(ids), part, np.int32), local, t1, t2, n, *products, *before, x]
        names = [c.split()[0] for c in _TURNS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _turn_hashes(seed: int) -> list[Column]:
    """Two hashes of role and text; the first column that is hashed is the seed."""
    return [F.xxhash64(F.lit(2 * seed + i), "role", "text").alias(f"t{i + 1}") for i in (0, 1)]


def _placed(turns: DataFrame, seed: int) -> DataFrame:
    """(conv, pos, t1, t2, n, f1, f2, e1, e2, x) of each turn.

    That is its place, hashes and length, the products with and without it, and
    the length with it.

    Turns are sorted over all tasks, so a conversation of any length may lie in
    several. Each task works out products of its own rows; a conversation's
    parts, at most two a task besides those it fills, are then composed.
    """
    length = F.length("text").cast("long").alias("n")
    keys = turns.select("conv", "turn", *_turn_hashes(seed), length)
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")]
    dealt = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    local = written(
        dealt.select("conv", "t1", "t2", "n").mapInArrow(_running, _TURNS), "turn-products"
    )
    of_part = local.groupBy("conv", "part").agg(
        F.max("local").alias("rows"), F.max_by(F.struct("f1", "f2", "x"), "local").alias("last")
    )
    cut = of_part.groupBy("conv").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1")
    # Only conversations that lie in several tasks: fewer rows than twice the tasks.
    pieces = of_part.join(cut, "conv").orderBy("conv", "part").collect()
    carried, held = [], {}
    for piece in pieces:
        rows, f1, f2, x = held.get(piece["conv"], (0, EMPTY, EMPTY, 0))
        carried.append((piece["conv"], piece["part"], rows, f1, f2, x))
        last = piece["last"]
        held[piece["conv"]] = (
            rows + piece["rows"],
            int(_product(f1, np.int64(last["f1"]))),
            int(_product(f2, np.int64(last["f2"]))),
            x + last["x"],
        )
    names = "conv long, part int, rows0 long, c1 long, c2 long, x0 long"
    if not carried:
        return local.withColumnRenamed("local", "pos").drop("part")
    before = turns.sparkSession.createDataFrame(carried, names)
    both = local.join(F.broadcast(before), ["conv", "part"], "left")

    def shifted(name: str, by: str) -> Column:
        return (F.col(name) + F.coalesce(by, F.lit(0))).alias(name)

    products = [
        _then(F.coalesce(f"c{lane}", F.lit(EMPTY)), F.col(f"{kind}{lane}")).alias(f"{kind}{lane}")
        for kind in "fe"
        for lane in _LANES
    ]
    pos = shifted("local", "rows0").alias("pos")
    return both.select("conv", pos, "t1", "t2", "n", *products, shifted("x", "x0"))


def _rebuilt(placed: DataFrame, base: Callable, head: Callable, max_head: int) -> DataFrame:
    """One row per rebuilt conversation and depth: fingerprint, last turn, parent's fingerprint.

    ``x`` is the length of all texts before the last one. A conversation is met
    by its base through one row per conversation, never by its turns.
    """
    own = F.least(head(F.col("conv")).cast("long"), F.lit(max_head))

    def at(place: Column | int, name: str) -> Column:
        return F.max(F.when(F.col("pos") == place, F.col(name)))

    kept = ("t1", "t2", "n", "f1", "f2", "x")
    first = placed.where(F.col("pos") <= max_head)
    heads = first.groupBy("conv").agg(
        *[at(i, name).alias(f"{name}_{i}") for i in range(1, max_head + 1) for name in kept]
    )
    counted = placed.groupBy("conv").agg(
        F.count(F.lit(1)).alias("turns"),
        F.max("x").alias("x_own"),
        at(own, "f1").alias("o1"), at(own, "f2").alias("o2"), at(own, "x").alias("xo"),
    ).withColumns({"h": own, "base": base(F.col("conv"))})
    turn = F.array(*[
        F.struct(F.lit(i).cast("long").alias("d"), *[F.col(f"{name}_{i}").alias(name) for name in kept])
        for i in range(1, max_head + 1)
    ])
    bases = heads.select(F.col("conv").alias("base"), F.filter(turn, lambda t: t["n"].isNotNull()).alias("head"))
    joined = counted.join(bases, "base", "left")
    taken = F.least("h", F.coalesce(F.size("head"), F.lit(0))).cast("long")
    joined = joined.withColumn("hb", F.when(F.col("head").isNull(), 0).otherwise(taken).cast("long"))
    joined = joined.withColumn("last", F.get("head", (F.col("hb") - 1).cast("int")))
    no_turn = F.coalesce(F.col("xo"), F.lit(0))
    convs = joined.select(
        "conv", "h", "hb", "base",
        F.when(F.col("hb") > 0, F.slice("head", 1, F.col("hb").cast("int"))).alias("head"),
        (F.col("hb") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("depth_end"),
        # What stands before the own turns, with the own head undone.
        *[
            _then(
                F.coalesce(F.col(f"last.f{lane}"), F.lit(EMPTY)),
                _undone(F.coalesce(f"o{lane}", F.lit(EMPTY))),
            ).alias(f"b{lane}")
            for lane in _LANES
        ],
        (F.coalesce("last.x", F.lit(0)) - no_turn).alias("xb"),
        F.when(F.col("turns") > F.col("h"), F.coalesce("last.x", F.lit(0)) + F.col("x_own") - no_turn)
        .otherwise(F.coalesce("last.x", F.lit(0))).alias("x_end"),
    )
    convs = written(convs, "rebuilt")
    zero = F.lit(0).cast("long")
    columns = ["conv", "depth", "depth_end", "f1", "f2", "g1", "g2", "t1", "t2", "n", "x", "x_end", "ref_conv", "ref_pos"]
    root = convs.select(
        "conv", "depth_end", "x_end", zero.alias("depth"),
        *[F.lit(EMPTY).cast("long").alias(name) for name in ("f1", "f2", "g1", "g2")],
        *[zero.alias(name) for name in ("t1", "t2", "n", "x", "ref_conv", "ref_pos")],
    )

    def before(head_turn: Column, lane: str) -> Column:
        previous = F.get(F.col("head"), (head_turn["d"] - 2).cast("int"))
        return F.when(head_turn["d"] > 1, previous[f"f{lane}"]).otherwise(F.lit(EMPTY))

    of_head = convs.where("hb > 0").withColumn("t", F.explode("head"))
    t = F.col("t")
    of_head = of_head.select(
        "conv", "depth_end", "x_end", t["d"].alias("depth"), *[t[c].alias(c) for c in ("f1", "f2", "t1", "t2", "n")],
        before(t, "1").alias("g1"), before(t, "2").alias("g2"),
        (t["x"] - t["n"]).alias("x"), F.col("base").alias("ref_conv"), t["d"].alias("ref_pos"),
    )
    of_own = placed.join(convs.where("depth_end > hb").drop("head", "base"), "conv").where("pos > h")
    of_own = of_own.select(
        "conv", "depth_end", "x_end", (F.col("hb") + F.col("pos") - F.col("h")).alias("depth"),
        *[_then(F.col(f"b{lane}"), F.col(f"f{lane}")).alias(f"f{lane}") for lane in _LANES],
        *[_then(F.col(f"b{lane}"), F.col(f"e{lane}")).alias(f"g{lane}") for lane in _LANES],
        "t1", "t2", "n", (F.col("xb") + F.col("x") - F.col("n")).alias("x"),
        F.col("conv").alias("ref_conv"), F.col("pos").alias("ref_pos"),
    )
    parts = [part.select(*columns) for part in (root, of_head, of_own)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])



_KEY = ("depth", "f1", "f2")


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One text of ids per node and batch, from rows ordered by node and id."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(4)]
        new = np.any([np.diff(c, prepend=c[:1]) != 0 for c in columns[:3]], axis=0)
        starts = np.concatenate([[0], np.flatnonzero(new)])
        ends = np.append(starts[1:], len(new))
        ids = columns[3].tolist()
        texts = [",".join(map(str, ids[a:b])) for a, b in zip(starts, ends, strict=True)]
        out = [pa.array(c[starts]) for c in columns] + [pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(out, [*_KEY, "first", "ids"])


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, from texts ordered by node and first id."""

    def out(done: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 3 + [pa.string()]
        columns = list(zip(*done, strict=True)) or [()] * 4
        arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, [*_KEY, "sha"])

    node, hashed = None, hashlib.sha256()
    for batch in batches:
        done = []
        keys = zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True)
        for key, text in zip(keys, batch.column(4), strict=True):
            if key != node:
                if node is not None:
                    done.append((*node, hashed.hexdigest()))
                node, hashed = key, hashlib.sha256()
            else:
                hashed.update(b",")
            hashed.update(text.as_py().encode())
        yield out(done)
    if node is not None:
        yield out([(*node, hashed.hexdigest())])


def _ends(rows: DataFrame) -> DataFrame:
    """(depth, f1, f2, sha): hash of the ids of the conversations that end at a node.

    All tasks join ids to texts, whatever node they belong to; the task that
    hashes a node on which very many end reads some texts, not their rows.
    """
    order = [*_KEY, "conv"]
    last = rows.where("depth = depth_end").select(*order)
    dealt = last.repartitionByRange(*order).sortWithinPartitions(*order)
    key = "depth long, f1 long, f2 long"
    texts = dealt.mapInArrow(_joined_ids, f"{key}, first long, ids string")
    by_node = texts.repartition(*_KEY).sortWithinPartitions(*_KEY, "first")
    return by_node.mapInArrow(_hashed_ids, f"{key}, sha string")


def _groups(rows: DataFrame) -> DataFrame:
    """Rows of equal fingerprints, with the extremes of what has to be equal."""
    ended = F.count(F.when(F.col("depth") == F.col("depth_end"), True))
    checked = ("t1", "t2", "g1", "g2", "ref_conv", "ref_pos")
    return rows.groupBy(*_KEY).agg(
        F.min("conv").alias("rep"),
        F.count(F.lit(1)).alias("n_convs"),
        ended.alias("n_ends"),
        F.min("x").alias("x"),
        *[F.min(c).alias(c) for c in checked],
        *[F.max(c).alias(f"{c}_max") for c in checked],
    )


def _differ(*names: str) -> Column:
    tests = [F.col(name) != F.col(f"{name}_max") for name in names]
    found = tests[0]
    for test in tests[1:]:
        found |= test
    return found


def _proven(groups: DataFrame, turns: DataFrame, seed: int) -> bool:
    """Whether every group holds one sequence of turns.

    Its rows end in turns of one hash and continue one group. Turns of one hash
    are equal where a group refers to one stored turn only; the texts of the
    others, and no more, are compared.
    """
    if not groups.where(_differ("t1", "t2", "g1", "g2")).isEmpty():
        return False
    shared = groups.where(_differ("ref_conv", "ref_pos")).select("t1", "t2").distinct()
    texts = turns.select("role", "text", *_turn_hashes(seed)).join(shared, ["t1", "t2"], "left_semi")
    extremes = [f(c).alias(f"{c}{i}") for c in ("role", "text") for i, f in enumerate((F.min, F.max))]
    found = texts.groupBy("t1", "t2").agg(*extremes)
    return found.where("role0 <> role1 or text0 <> text1").isEmpty()


def prefix_trie(
    turns: DataFrame,
    base: Callable[[Column], Column],
    head: Callable[[Column], Column],
    max_head: int,
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    ``turns`` has conv_id, turn, role and text. Conversation c is rebuilt from
    the first ``head(c)`` turns of conversation ``base(c)`` (at most
    ``max_head``; all if it has fewer, none if it is absent) and its own turns
    after its first ``head(c)``. A conversation must be its own base or the
    base of a bounded number of others.

    Returns longs (and one string): conv_id, the smallest member; depth;
    parent_conv_id (NULL at the root); n_convs; n_children; n_leaves and
    saved_tokens over the subtree; ends_sha256 of the members that end here.
    Sums over a subtree need no walk: a conversation is the smallest member
    from some depth on, so what it adds to all nodes above follows from that
    depth and from running text lengths.

    Turns are ordered by turn, NULL first, and turns of equal number by a hash
    of role and text. NULL roles and texts are empty; rows without a
    conversation are not read; repeated rows are turns of their own. No rows,
    no root. Other columns are not read.
    """
    ship(turns.sparkSession)
    source = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    seed = 0
    while True:
        placed = _placed(source, seed)
        rows = written(_rebuilt(placed, base, head, max_head), "prefixes")
        groups = written(_groups(rows), "prefix-groups")
        if _proven(groups, source, seed):
            break
        seed += 1
    smallest = groups.groupBy(F.col("rep").alias("conv")).agg(
        F.min("depth").alias("from_depth"),
        F.min("x").alias("from_x"),
        F.count(F.when(F.col("n_ends") == F.col("n_convs"), True)).alias("leaf"),
    )
    known = rows.join(smallest, "conv", "left")
    above = F.coalesce("from_x", F.col("x_end")) - F.col("x")
    child = (F.col("from_depth") <= F.col("depth") + 1) & (F.col("depth") < F.col("depth_end"))
    sums = known.groupBy(*_KEY).agg(
        F.count(F.when(child, True)).alias("n_children"),
        F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
        F.sum(F.greatest(above, F.lit(0))).alias("saved_tokens"),
    )
    parents = groups.select(
        (F.col("depth") + 1).alias("depth"),
        F.col("f1").alias("g1"),
        F.col("f2").alias("g2"),
        F.col("rep").alias("parent_conv_id"),
    )
    nodes = groups.select(*_KEY, "g1", "g2", F.col("rep").alias("conv_id"), "n_convs")
    nodes = nodes.join(sums, [*_KEY]).join(parents, ["depth", "g1", "g2"], "left")
    return nodes.join(_ends(rows), [*_KEY], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.lit(_NO_IDS)).alias("ends_sha256"),
    )
