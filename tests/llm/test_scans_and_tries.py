"""Licence scans, whitening and the prefix trie against brute force and awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from oracle_check import connect, difference
from pyspark.sql import functions as F

from martlens.llm import prefix_trie as trie_module
from martlens.llm import queries as Q
from martlens.llm import whitening
from martlens.llm.licences import PHRASES, TEMPLATES, Automaton, Chains, scan_licences
from martlens.llm.prefix_trie import prefix_trie
from martlens.llm.whitening import whiten

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def base_places(text):
    w = words(text)
    return sorted(
        (i, label)
        for phrase, label in PHRASES
        for i in range(len(w))
        if w[i : i + len(phrase.split())] == phrase.split()
    )


def check_base(rows, docs):
    want = defaultdict(list)
    for doc_id, text in docs:
        places = base_places(text)
        want[doc_id].append((
            len(words(text)), len(places),
            min((i for i, _ in places), default=None), max((i for i, _ in places), default=None),
            ",".join(sorted({label for _, label in places})),
        ))
    found = defaultdict(list)
    for r in rows:
        found[r.doc_id].append((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert {k: sorted(v, key=str) for k, v in found.items()} == {
        k: sorted(v, key=str) for k, v in want.items()
    }


@pytest.mark.parametrize("seed", range(20))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    sequences = [[rng.randrange(3) for _ in range(rng.randrange(0, 12))] for _ in range(4)]
    runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    text = [rng.randrange(4) for _ in range(60)]
    machine = Automaton(sequences)
    for at, (state, length) in enumerate(machine.read(text)):
        fits = [n for n in range(at + 2) if n == 0 or tuple(text[at + 1 - n : at + 1]) in runs]
        assert length == max(fits)
        run = text[at + 1 - length : at + 1]
        if length:
            want = [
                (k, i + length - 1)
                for k, s in enumerate(sequences)
                for i in range(len(s))
                if s[i : i + length] == run
            ]
            assert machine.places[state] == want
        whole = {k for k in machine.whole[state] if len(sequences[k]) <= length}
        assert whole == {k for k, s in enumerate(sequences) if s and text[: at + 1][-len(s) :] == s and len(s) <= length}


def test_chains_join_what_lies_near_and_in_order():
    chains = Chains([30])
    chains.add(0, 100, 109, 9)
    chains.add(0, 112, 121, 19)  # two words left out
    chains.add(0, 300, 309, 29)  # too far off
    chains.add(0, 312, 321, 9)  # out of order
    assert chains.spans() == [(0, 100, 121, 20)]


def test_licences(spark, sf0001):
    apache = next(text for label, text in TEMPLATES if label == "apache-2.0" and len(text) > 100)
    broken = apache.replace("except in compliance", "unless in full compliance").replace(" ", "\n# ")
    mit = next(text for label, text in TEMPLATES if label == "mit" and len(text) > 100)
    rows = [
        (1, None), (2, ""), (3, "Under the MIT-License or the mit license, CC BY. Écc by"), (4, broken),
        (5, "x " * 30_000 + mit + " y" * 30_000 + " " + mit), (5, "the apache"), (None, "Licensed under CC BY-NC 4.0."),
        (6, "licensed under the apache"), (7, "the " * 400_000 + "apache license"),
        (8, "GNU General Public License" * 3), (9, "free of charge to any person obtaining a copy"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit(7))
    found = scan_licences(docs).collect()
    check_base(found, rows)
    by = {r.doc_id: r for r in found if r.doc_id != 5}
    assert by[4].labels == "apache,apache-2.0" and by[4].spans[0].share > 0.9 and by[4].spans[0].first_word == 0
    long = next(r for r in found if r.doc_id == 5 and r.n_words > 9)
    n = len(words(mit))
    assert [(s.label, s.first_word, s.last_word, s.covered) for s in long.spans] == [
        ("mit", 30_000, 30_000 + n - 1, n), ("mit", 60_000 + n, 60_000 + 2 * n - 1, n),
    ]
    assert by[None].labels == "cc-by,cc-by-nc-4.0" and by[None].score == 1.0
    assert by[6].labels == by[9].labels == "" and by[6].score == 0.0 and by[6].longest_match == 4
    assert scan_licences(docs.limit(0)).count() == 0
    table = Q.table(spark, sf0001, "documents")
    check_base(Q.op11_licences(spark, sf0001).collect(), [(r.doc_id, r.text) for r in table.collect()])


def test_licences_of_other_lists(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a a")], "doc_id int, text string")
    found = {r.doc_id: r for r in scan_licences(docs, [("b c", "x"), ("a", "y")], [("z", "b c d")]).collect()}
    assert found[1].base_labels == "x" and found[1].labels == "x,z" and found[1].n_base == 1
    assert scan_licences(docs, [], []).where("labels = '' and score = 0").count() == 2


def steps_of(rows):
    usable = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    return usable, np.floor(64 * np.array([v for _, v in usable], float)).astype(np.int64) + 1_000_000


def check_whitening(found, rows, components):
    usable, x = steps_of(rows)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, x.shape[1])
    assert len(found) == k * len(usable)
    want = sorted((i, int(d)) for (i, _), d in zip(usable, ((n * x - s) ** 2).sum(axis=1), strict=True))
    assert sorted((r.vec_id, r.deviation) for r in found if r.component == 1) == want
    got = np.zeros((len(usable), k))
    at = {i: j for j, (i, _) in enumerate(usable)}
    for r in found:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9
        assert r.identity_error < 1e-6
    full = (n * x - s) / n @ vectors[:, :k] / np.sqrt(values[:k])
    assert np.abs(np.abs(full) - np.abs(got)).max() < 1e-6
    for c in range(k):
        assert min(np.abs(full[:, c] - got[:, c]).max(), np.abs(full[:, c] + got[:, c]).max()) < 1e-6


def test_whitening(spark, sf0001):
    rows = [(r.vec_id, r.embedding) for r in Q.table(spark, sf0001, "embeddings").collect()]
    check_whitening(Q.op12_whitening(spark, sf0001).collect(), rows, 16)


def test_whitening_of_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS_PER_BLOCK", 4)
    monkeypatch.setattr(whitening, "COLS_PER_BLOCK", 2)
    monkeypatch.setattr(whitening, "BLOCKS_PER_TASK", 2)
    rng = np.random.default_rng(1)
    some = [(i, (rng.normal(size=3) * [1, 2, 5]).tolist()) for i in range(40)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 1.0]), (103, [float("inf"), 0.0, 1.0]), (104, [])]
    schema = "vec_id long, embedding array<double>"
    rows = some + odd + [(200 + i, some[0][1]) for i in range(30)]
    df = spark.createDataFrame(rows, schema).withColumns({"n": F.lit(1), "index": F.lit(2), "x": F.lit("a")})
    check_whitening(whiten(df).collect(), rows, 16)
    check_whitening(whiten(df, components=2).collect(), rows, 2)
    shorter = spark.createDataFrame([(None, [1.0]), (None, [2.0])], schema)
    assert whiten(df.select("vec_id", "embedding").unionByName(shorter)).where("vec_id is null").count() == 0
    assert whiten(df.limit(0)).count() == whiten(spark.createDataFrame(odd, schema)).count() == 0
    one = whiten(spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0])], schema)).collect()
    assert len(one) == 4 and all(r.whitened is None and r.deviation == 0 and r.explained is None for r in one)
    large = [(1, [2.0**40, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])]
    found = {r.vec_id: r.deviation for r in whiten(spark.createDataFrame(large, schema)).collect()}
    assert found[1] is None and found[2] is None and len(found) == 3


def base(c):
    return c - c % 100


def head(c):
    return F.crc32(c.cast("string").cast("binary")) % 6


def brute_trie(rows):
    stored = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            stored[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in stored.items()}
    full, members = {}, defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = (*own.get(c - int(np.fmod(c, 100)), [])[:h], *own[c][h:])
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    children, leaves, saved = (defaultdict(int) for _ in range(3))
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, m in members.items():
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(m) - 1) * len(path[-1][1]) if path else 0
            leaves[path[:d]] += path not in children
    found = []
    for path, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if full[c] == path)
        parent = min(members[path[:-1]]) if path else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        found.append((min(m), len(path), parent, len(m), children.get(path, 0), leaves[path], saved[path], sha))
    return sorted(found, key=str)


def same(df, rows):
    return sorted((tuple(r) for r in df.collect()), key=str) == brute_trie(rows)


def test_prefix_trie(spark, sf001, sf0001):
    sql = Q.oracle_sql()["op13_prefix_trie"]
    assert difference(Q.op13_prefix_trie(spark, sf001), connect(sf001), sql) is None
    rows = [tuple(r) for r in Q.table(spark, sf0001, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert same(Q.op13_prefix_trie(spark, sf0001), rows)


def _awkward_turns():
    rows = [(c, t, "user" if t % 2 else None, f"t{t}") for c in (0, 7, 100, 101, 150, 201) for t in range(7)]
    rows += [(c, t, "user", "same") for c in range(300, 320) for t in range(4)]  # copies
    rows += [(400, None, "a", "first"), (400, -5, "a", ""), (400, 2, "b", None), (401, 1, "", "x")]
    rows += [(-5, 1, "u", "\U0001f642é"), (-105, 1, "u", "z"), (-100, 1, "u", "z")]
    rows += [(None, 1, "u", "lost"), (500, 3, "u", "twice"), (500, 3, "u", "twice")]
    rows += [(600, t, "u", f"long {t % 3}") for t in range(300)] + [(601, t, "u", f"long {t % 3}") for t in range(299)]
    rows += [(602, 1, "u", "y" * 100_000)]
    return rows


@pytest.mark.parametrize("parts", [1, 13])
def test_prefix_trie_of_awkward_turns(spark, parts):
    """With many partitions the long conversations lie in several."""
    rows = _awkward_turns()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = turns.withColumns({"depth": F.lit(1), "f1": F.lit("x"), "conv": F.lit(2)})
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert same(prefix_trie(turns, base, head, 5), rows)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert prefix_trie(turns.limit(0), base, head, 5).count() == 0


@pytest.mark.parametrize("alike", [["f"], ["t"]])
def test_equal_fingerprints_of_unequal_turns_are_found(spark, monkeypatch, alike):
    """From the first seed all turns get one hash (or one map): another seed is tried."""
    rows = _awkward_turns()[:42]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain, seeds = trie_module._turn_hashes, []

    def hashes(seed):
        seeds.append(seed)
        if seed:
            return plain(seed)
        value = F.lit(5).cast("long") if alike == ["t"] else F.xxhash64("text").bitwiseAND(F.lit(1))
        return [value.alias("t1"), value.alias("t2")]

    monkeypatch.setattr(trie_module, "_turn_hashes", hashes)
    assert same(prefix_trie(turns, base, head, 5), rows)
    assert max(seeds) == 1
