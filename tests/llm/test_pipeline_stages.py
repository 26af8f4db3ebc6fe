"""Each stage of the pipeline, and the classifier's training, against brute force."""

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from martlens.llm import queries as Q
from martlens.llm import toxicity
from martlens.llm.linear import fit_marked, sigmoid
from martlens.llm.toxicity import CLASSES, n_grams, score_toxicity, train

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, removed_lines int"
ITEM = " ".join(f"item{i}" for i in range(12))


def planted() -> list[tuple]:
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]

    def prose(n):
        return " ".join(rng.choice(words, n))

    rows = []
    for i in range(60):
        text = prose(40)
        if i % 4 == 0:
            text += f"\nyou awful grubflurp number {i} you grubflurp"  # toxic
        if i % 3 == 0:
            text += "\nAccept all cookies of this site"  # on twenty sites
        rows.append((i, text, "en", f"site{i}"))
    long = prose(30_000)
    near = rows[1][1].split()
    near[20] = "changed"
    rows += [
        (70, rows[1][1], "en", "copy"), (71, " ".join(near), "en", "near"), (72, long, "de", "long"),
        (73, f"{prose(300)} {ITEM} {prose(300)}", "en", "leak"), (74, ITEM, "en", "leak"),
        (75, None, None, None), (76, "", "en", "x"), (77, " \n ", "en", "x"),
        (None, prose(30), "en", "none"), (5, rows[5][1], "en", "site5"), (5, prose(30), "en", "twice"),
        (78, "two words", "en", "y"), (79, "two  words", "en", "z"),
    ]
    return [(*row, len(row[1] or ""), f"k{row[0]}", 7) for row in rows]


def without_shared_lines(rows, least=8):
    sites, first = defaultdict(set), {}
    for i, text, _, source, *_ in rows:
        for place, line in enumerate((text or "").split("\n")):
            if line.strip(" "):
                sites[line.strip(" ")].add(source)
                key = ((i is None, i or 0), place)
                first[line.strip(" ")] = min(first.get(line.strip(" "), key), key)
    out = []
    for i, text, *rest in rows:
        lines = None if text is None else text.split("\n")
        kept = lines and [
            line for place, line in enumerate(lines)
            if not line.strip(" ") or len(sites[line.strip(" ")]) < least
            or first[line.strip(" ")] == ((i is None, i or 0), place)
        ]
        out.append((i, None if lines is None else "\n".join(kept)))
    return out


def one_of_each(rows):
    def shingles(text):
        w = re.findall(r"[^ \t-\r]+", (text or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for i, row in enumerate(rows):
        groups[find(i) if sets[i] else ("none", i)].append(row.doc_id)
    return sorted((min(g, key=lambda d: (d is None, d or 0)) for g in groups.values()), key=str)


def holds_item(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    item = ITEM.split()
    have = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = {tuple(item[i : i + 5]) for i in range(len(item) - 4)}
    return 100 * len(want & have) >= 80 * len(want)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("planted")
    spark.createDataFrame(planted(), SCHEMA).write.parquet(str(path / "documents.parquet"))
    labels = [(i, 1, int(i % 4 == 0)) for i in range(60) if i % 7]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    items = spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string")
    items.write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_each_stage_against_brute_force(spark, folder):
    docs = Q.table(spark, folder, "documents")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    kept = {}
    for name in ("toxicity", "line_dedup", "jaccard_join", "decontamination"):
        found = stages[name](spark, docs, folder)
        assert found.columns == columns, name
        rows = found.collect()
        kept[name] = (docs.collect(), rows)
        docs = spark.createDataFrame(rows, found.schema)
    before, after = kept["toxicity"]
    scores = {(r.doc_id, r.predicted) for r in score_toxicity(spark.createDataFrame(before, SCHEMA), Q.table(spark, folder, "labels")).collect()}
    assert sorted((r.doc_id for r in after), key=str) == sorted(
        (r.doc_id for r in before if (r.doc_id, 1) not in scores), key=str
    )
    left = {r.doc_id for r in after}
    assert not {i for i in range(60) if i % 4 == 0} & left and {i for i in range(60) if i % 4} <= left
    before, after = kept["line_dedup"]
    assert sorted(((r.doc_id, r.text) for r in after), key=str) == sorted(
        without_shared_lines([tuple(r) for r in before]), key=str
    )
    assert all(r._key == f"k{r.doc_id}" for r in after)
    before, after = kept["jaccard_join"]
    assert sorted((r.doc_id for r in after), key=str) == one_of_each(before)
    assert len(after) < len(before)
    before, after = kept["decontamination"]
    assert sorted((r.doc_id for r in after), key=str) == sorted(
        (r.doc_id for r in before if not holds_item(r.text)), key=str
    )
    assert {73, 74} & {r.doc_id for r in before} and not {73, 74} & {r.doc_id for r in after}
    pieces = stages["packing"](spark, docs, folder).collect()
    whole = defaultdict(int)
    for p in pieces:
        whole[p.doc_id] += p.length
    assert set(whole) == {r.doc_id for r in after}


def test_the_pipeline_runs_whole_and_on_nothing(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    for name in ("documents", "labels", "benchmark"):
        Q.table(spark, folder, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def dense_fit(x, labels, penalty, rounds):
    """The same minimisation over a dense matrix: plain accelerated gradient steps."""
    n = len(labels)
    w, b = np.zeros(x.shape[1]), float(np.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5)))
    v, c, t, last = w.copy(), b, 1.0, np.inf
    norms = (x * x).sum(axis=1)
    step = max(1 / (0.25 * (norms.max() + 1) + penalty), 1 / (0.25 * (4 * norms.mean() + 1) + penalty))
    for _ in range(rounds):
        s = x @ v + c
        e = sigmoid(s) - labels
        w2, b2 = v - step * (x.T @ e / n + penalty * v), c - step * e.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        loss = np.logaddexp(0, np.where(labels > 0, -s, s)).mean()
        if loss > last:
            v, c, t2 = w2.copy(), b2, 1.0
        w, b, t, last = w2, b2, t2, loss
    return w, b


def test_training_against_brute_force(spark, folder):
    """Counts, ratios, ranking and weights from dense matrices in numpy."""
    docs, labels = Q.table(spark, folder, "documents"), Q.table(spark, folder, "labels")
    model = train(docs, labels)
    held = {r.doc_id for r in labels.where(toxicity.held_out(F.col("doc_id"))).collect()}
    texts, seen = {}, defaultdict(list)
    for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect():
        seen[r.doc_id].append((r.h, r.text))
    marks = [(r.doc_id, r.toxic) for r in labels.collect() if r.doc_id not in held]
    texts = [min(seen[i])[1] for i, _ in marks]
    y = np.array([t for _, t in marks], float)
    has = np.zeros((len(marks), CLASSES), bool)
    for row, found in enumerate(n_grams(texts, np.ones(CLASSES, bool))):
        has[row, found] = True
    a, b = has[y > 0].sum(axis=0) + 0.5, has[y == 0].sum(axis=0) + 0.5
    n, m = (y > 0).sum() + 1.0, (y == 0).sum() + 1.0
    ratio = np.log(a / n) - np.log(b / m)
    z = np.abs(ratio / np.sqrt(1 / a + 1 / b - 1 / n - 1 / m))
    used = has.any(axis=0)
    best = np.lexsort((np.arange(CLASSES), -np.where(used, z, -1)))[: toxicity.FEATURES]
    best = best[used[best]]
    # Ties of z that differ in the last bit may be ranked otherwise; features are compared by z.
    assert len(model.classes) == len(best) and np.allclose(np.sort(z[model.classes]), np.sort(z[best]))
    x = has[:, model.classes] * ratio[model.classes]
    w, offset = dense_fit(x, y, 1e-5, 400)
    assert abs(offset - model.offset) < 1e-6
    assert np.abs(w * ratio[model.classes] - model.weights).max() < 1e-6


def test_sixteen_thousand_rows_fit_in_little_memory():
    """Peak of the arrays that the fit makes, at the size of the whole sample."""
    import tracemalloc

    rng = np.random.default_rng(0)
    lengths = rng.integers(0, 1000, 16_000)
    lengths[::500] = 0
    columns = rng.integers(0, 16_000, lengths.sum()).astype(np.uint16)
    values, labels = rng.normal(size=16_000), (rng.random(16_000) < 0.4).astype(float)
    tracemalloc.start()
    fit_marked(columns, lengths, values, labels, 1e-5, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
