"""Operators against brute force, on awkward rows and on empty tables."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from oracle_check import connect, difference
from pyspark.sql import functions as F

import corpus_pipeline
from martlens.llm import queries as Q
from martlens.llm.contamination import contained_items, decontaminate
from martlens.llm import cotraining
from martlens.llm.cotraining import score_quality
from martlens.llm.jaccard_join import jaccard_components, keep_one
from martlens.llm.line_dedup import remove_shared_lines
from martlens.llm.packing import cutting_stock, pack
from martlens.llm.sharding import shard_documents
from martlens.llm.token_files import Shard, read_index, write_tokens
from martlens.llm.tokens import WordEncoder
from martlens.llm.toxicity import score_toxicity, without_toxic
from martlens.llm.url_filter import judge_urls
from martlens.llm.vector_dedup import vector_links

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, h string, size string"
LONG = "lorem ipsum Dolor,\n" * 20_000
BASE = " ".join(f"w{i}" for i in range(120))


@pytest.fixture(scope="module")
def awkward(spark):
    """Null, empty and long texts, null and repeated ids, near copies, clashing names."""
    near = BASE.replace("w60", "other")
    rows = [
        (1, None, "en", "a", None), (2, "", None, None, 0), (3, LONG, "en", "b", 10),
        (4, BASE, "en", "a", 5), (4, BASE, "en", "a", 5), (5, near, "xx", "c", -1),
        (None, BASE, "en", "a", 5), (6, "two words", "en", "a", 9), (7, "Two\tWORDS", "en", "b", 9),
        (8, " \n ", "en", "a", 3), (9, "<|endoftext|> naïve Straße Σίσυφος 1.5 it's!! ﬁ", "en", "a", 3),
    ]
    return spark.createDataFrame([(*row, 1, "x", "y") for row in rows], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def tokenizer(spark):
    return Q.tokenizer(spark)


def test_words_are_encoded_as_the_library_encodes_texts(awkward, sf001, spark, tokenizer):
    encoder = WordEncoder.of(tokenizer)
    texts = [r.text for r in awkward.collect()] + [
        r.text for r in Q.table(spark, sf001, "documents").collect()
    ]
    texts += ["Don't I'LL we've ça ÀÉß x²½ µm  a\tb\r\nc 's''t 12ab34 _ab_ <|endoftext|> ~ \x0b \x85 \xa0 ª",
              "ÀÈ÷×ÿ", "naïve ÿ'D café's", "a\x1cb", "ab" * 5000, "'" * 300, "e\u0301 É", "1²3"]
    for text, data in zip(texts, encoder.encode(texts), strict=True):
        assert data == encoder.whole(text or "")


def test_url_rules(spark, sf001):
    assert difference(Q.op1_url_filter(spark, sf001), connect(sf001), Q.oracle_sql()["op1_url_filter"]) is None
    pages = spark.createDataFrame(
        [(1, None), (2, "no scheme"), (3, "https://A.NET/x?y"), (None, "http://net#/"), (3, "http://b.net/a"),
         (4, "x://" + "d." * 300 + "net/")],
        "page_id long, url string",
    ).withColumn("host", F.lit("clash"))
    rules = spark.createDataFrame(Q.URL_RULES, "host string, path string, verdict string")
    found = sorted(tuple(r[:1] + r[3:]) for r in judge_urls(pages, rules).where("page_id is not null").collect())
    assert [(i, v) for i, _, v in found] == [
        (1, "allow"), (2, "allow"), (3, "block"), (3, "block"), (4, "block")]
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert judge_urls(pages, rules.limit(0)).where("verdict = 'allow'").count() == 6


def check_packing(pieces, docs, encoder):
    by_sequence, by_start = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
        by_start[p.doc_id, p.doc_tokens].append(p)
    for held in by_sequence.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 4096
    want = defaultdict(int)
    for d in docs:
        ids = encoder.whole(d.text or "") + (2).to_bytes(4, "little")
        want[d.doc_id, len(ids) // 4] += 1
        for p in by_start[d.doc_id, len(ids) // 4]:
            assert p.ids_crc32 == zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)])
    for key, count in want.items():
        assert sum(p.length for p in by_start[key]) == count * key[1]


def test_packing(awkward, nothing, spark, sf0001, tokenizer):
    encoder = WordEncoder.of(tokenizer)
    check_packing(pack(awkward, tokenizer).collect(), awkward.collect(), encoder)
    docs = Q.table(spark, sf0001, "documents")
    pieces = pack(docs, tokenizer).collect()
    check_packing(pieces, docs.select("doc_id", "text").collect(), encoder)
    total = sum(p.length for p in pieces)
    assert len({p.sequence_id for p in pieces}) <= total // 4096 + 3
    assert pack(nothing, tokenizer).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_cutting_stock_holds_all(seed):
    rng = np.random.default_rng(seed)
    demand = {int(w): int(n) for w, n in zip(rng.integers(1, 33, 12), rng.integers(1, 900, 12), strict=True)}
    patterns = cutting_stock(demand, 32)
    held = defaultdict(int)
    for items, times in patterns:
        assert sum(w * n for w, n in items.items()) <= 32
        for w, n in items.items():
            held[w] += n * times
    assert all(held[w] >= n for w, n in demand.items())
    assert sum(t for _, t in patterns) <= sum(w * n for w, n in demand.items()) / 32 * 1.5 + 3


def test_token_files(awkward, nothing, spark, tokenizer):
    found = read_index(spark, write_tokens(awkward, tokenizer, shard_ids=64)).collect()
    encoder = WordEncoder.of(tokenizer)
    want = defaultdict(list)
    for d in awkward.collect():
        ids = encoder.whole(d.text or "") + (2).to_bytes(4, "little")
        want[d.doc_id].append((len(ids) // 4, zlib.crc32(ids)))
    got = defaultdict(list)
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        got[r.doc_id].append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    order = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert read_index(spark, write_tokens(nothing, tokenizer)).count() == 0


def test_a_shard_is_read_at_any_place():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 3, rng.integers(1, 400)).astype("<u4").tobytes() for _ in range(30)]
    shard = Shard.open(Shard.pack([None, *range(29)], docs))
    assert len(shard.rules) and shard.ids().astype("<u4").tobytes() == b"".join(docs)
    for i, data in enumerate(docs):
        ids = np.frombuffer(data, "<u4")
        for low in range(0, len(ids), 37):
            assert (shard.part(i, low, len(ids)) == ids[low:]).all()


def groups_by_brute_force(rows, width, percent):
    sets = []
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        runs = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
        sets.append((doc, runs or ({tuple(words)} if words else set())))
    group = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sets, group


@pytest.mark.parametrize(("width", "percent", "leaf"), [(3, 90, 256), (5, 80, 3)])
def test_jaccard_components(awkward, nothing, spark, sf0001, width, percent, leaf):
    docs = Q.table(spark, sf0001, "documents").select("doc_id", "text")
    both = awkward.where("doc_id <> 3").select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 10**6)
    docs = docs.unionByName(both)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets, group = groups_by_brute_force(rows, width, percent)
    least = {}
    for (doc, _), g in zip(sets, group, strict=True):
        least[g] = min(least.get(g, doc), doc)
    want = sorted((doc, len(s), least[g] if s else doc) for (doc, s), g in zip(sets, group, strict=True))
    assert sorted(tuple(r) for r in jaccard_components(docs, width, percent, leaf).collect()) == want
    assert jaccard_components(nothing).count() == 0


def test_one_of_each_group_stays(awkward):
    kept = keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = sorted(r.doc_id or 0 for r in kept.collect())
    assert ids == [1, 2, 3, 4, 6, 8, 9]


def test_vector_links(spark, nothing):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    rows = [(i, (base[i % 20] + rng.standard_normal(16) * 0.06 * (i // 20)).tolist(), i % 3) for i in range(60)]
    rows += [(60, rows[0][1], 0), (61, rows[0][1], 0), (62, None, 1), (63, [0.0] * 16, 1),
             (64, [float("nan")] * 16, 1), (65, rows[1][1], None), (66, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cid", F.lit(1))
    found = {r.vec_id: tuple(r)[1:] for r in vector_links(df, block=8).collect()}
    vectors = {r.vec_id: (r.label, np.array(r.embedding or [], float)) for r in df.collect()}
    near = defaultdict(set)
    for i, (a, x) in vectors.items():
        for j, (b, y) in vectors.items():
            if i != j and a is not None and a == b and len(x) == len(y) and x.any() and y.any():
                if (x @ y) / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    near[i].add(j)
    assert sum(n for n, _, _ in found.values()) >= 0.9 * sum(map(len, near.values()))
    assert all(found[i][0] <= len(near[i]) for i in vectors)
    assert all(found[i] == (0, i, True) for i in (62, 63, 64, 65, 66))
    assert found[61][0] >= 2 and found[61][1] == found[60][1] == 0
    assert vector_links(df.limit(0)).count() == 0


def labels_for(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_classifiers(spark, sf001, awkward, nothing):
    labels = Q.table(spark, sf001, "labels")
    docs = Q.table(spark, sf001, "documents")
    scores = score_toxicity(docs, labels)
    marked = scores.join(labels, "doc_id").where("toxic is not null").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in marked)
    assert np.mean([r.predicted == r.toxic for r in marked]) > 0.93
    assert not [r for r in marked if r.predicted and not r.toxic]
    good = score_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in good]) > 0.93
    few = labels_for(spark, [(4, 1, None), (None, 0, 1), (3, None, 0), (999, 1, 1)])
    for score in (score_toxicity, score_quality):
        assert score(awkward, few).count() == 11
        assert score(awkward, few.limit(0)).where("abs(score - 0.5) < 1e-9").count() == 11
        assert score(nothing, few).count() == 0
    assert without_toxic(awkward, few).columns == awkward.columns


def test_few_toxic_rows_are_learnt_from(spark, sf0001):
    docs, labels = Q.table(spark, sf0001, "documents"), Q.table(spark, sf0001, "labels")
    marked = score_toxicity(docs, labels).join(labels, "doc_id").where("toxic is not null").collect()
    held = [r for r in marked if r.held_out and r.toxic]
    assert held and all(r.predicted for r in held)
    assert not [r for r in marked if r.predicted and not r.toxic]
    assert len({r.score for r in marked}) > len(marked) / 2


def test_all_unlabelled_documents_pass_between_the_views(spark):
    texts = ["Plain words of every kind make up a good line here.", "|| ## || $$ || ## ||"]
    docs = spark.range(4_000).selectExpr(
        "id as doc_id", f"if(id % 2 = 0, '{texts[0]}', '{texts[1]}') as text", "'en' as lang",
        "if(id % 2 = 0, 'a', 'c') as source", "50 as n_chars",
    )
    labels = labels_for(spark, [(i, 1 - i % 2, None) for i in range(200)])
    every = cotraining._features(docs)
    sample, pool = cotraining._samples(every, labels)
    x, m = cotraining._both([r[0] for r in sample], [r[1] for r in sample])
    want = every.where("not held_out and doc_id >= 200").count()
    assert pool.count() == want > 3_000
    assert cotraining.co_train(x, m, np.array([r[2] for r in sample], float), pool)[1] == [want, want]
    scores = score_quality(docs, labels).collect()
    assert len(scores) == 4_000 and all(r.predicted == 1 - r.doc_id % 2 for r in scores)


@pytest.mark.parametrize("score", [score_toxicity, score_quality])
def test_a_repeated_id_is_learnt_from_once(spark, sf0001, score):
    docs, labels = Q.table(spark, sf0001, "documents"), Q.table(spark, sf0001, "labels")
    least = labels.where("toxic = 0 and quality = 0 and crc32(cast(cast(doc_id as string) as binary)) % 5 > 1")
    copies = docs.join(least.orderBy("doc_id").limit(1), "doc_id", "left_semi").crossJoin(spark.range(60)).drop("id")
    assert copies.count() == 60
    once, often = (
        {r.doc_id: r.score for r in score(d, labels).collect()} for d in (docs, docs.unionByName(copies))
    )
    assert all(abs(once[i] - often[i]) < 1e-6 for i in once)


def test_contained_items(spark, sf001, awkward, nothing):
    sql = Q.oracle_sql()["op4_contamination"]
    assert difference(Q.op4_contamination(spark, sf001), connect(sf001), sql) is None
    part = " ".join(f"W{i}" for i in range(20, 40))
    items = spark.createDataFrame(
        [(1, part), (2, None), (3, ""), (4, "two words"), (None, part), (1, part), (5, "absent " * 30)],
        "item_id long, text string",
    )
    found = {(r.doc_id, r.item_id) for r in contained_items(awkward, items).collect()}
    assert found == {(d, i) for d in (4, 5, None) for i in (1, None)} | {(6, 4), (7, 4)}
    left = decontaminate(awkward, items)
    assert left.columns == awkward.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 8, 9]
    assert contained_items(nothing, items).count() == contained_items(awkward, items.limit(0)).count() == 0


def test_shards(awkward, nothing):
    rows = awkward.unionByName(awkward.where("doc_id = 4")).collect()
    found = shard_documents(awkward.unionByName(awkward.where("doc_id = 4")), shards=4).collect()
    want = sorted((r.doc_id or 0, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in found) == want
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    sizes = [len(by[s]) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1
    assert shard_documents(nothing).count() == 0


def test_shared_lines(spark, sf001, awkward, nothing):
    sql = Q.oracle_sql()["op9_line_dedup"]
    assert difference(Q.op9_line_dedup(spark, sf001), connect(sf001), sql) is None
    rows = [(i, f"own {i}\n shared \nshared", f"s{i % 4}", 5) for i in range(8)] + [(None, "shared", "s0", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    docs = docs.withColumn("place", F.lit(1))
    found = {r.doc_id: r for r in remove_shared_lines(docs, min_sites=4).collect()}
    assert found[0].text == "own 0\n shared " and found[0].n_chars == len(found[0].text)
    assert found[5].text == "own 5" and found[5].removed_lines == 2 and found[None].text == ""
    assert remove_shared_lines(docs, min_sites=5).where("removed_lines > 0").count() == 0
    assert remove_shared_lines(awkward).count() == 11 and remove_shared_lines(nothing).count() == 0


def test_pipeline(spark, sf0001, tokenizer):
    docs = Q.table(spark, sf0001, "documents")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf0001)
        assert kept.columns == names and 0 < kept.count() <= docs.count(), name
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf0001).collect()
    check_packing(pieces, docs.collect(), WordEncoder.of(tokenizer))
    assert corpus_pipeline.ORACLE_SQL is None
