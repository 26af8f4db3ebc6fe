"""Co-training against a version of it that holds all rows in numpy."""

import numpy as np
from pyspark.sql import functions as F

from martlens.llm import cotraining
from martlens.llm.cotraining import ROUNDS, SURE, co_train, content, score_quality
from martlens.llm.linear import sigmoid


def whole(docs):
    rows = cotraining._features(docs).select("x", "m").collect()
    return cotraining._both([bytes(r[0]) for r in rows], [bytes(r[1]) for r in rows])


def docs_of(spark, sources, n, lang="'en'"):
    return spark.range(n).selectExpr(
        "id AS doc_id", "concat('word ', id % 17, repeat(' abc', cast(id % 5 AS int)), if(id % 2 = 0, ' fine text here', ' #### !!!!'))"
        " AS text", f"{lang} AS lang", f"{sources} AS source", "id % 300 AS n_chars",
    )


def brute(own, y, pool):
    """Rounds, labels and Newton steps over plain arrays."""
    views = []
    for x, more in zip(own, pool, strict=True):
        every = np.vstack([x, more])
        spread = every.var(axis=0)
        scale = np.sqrt(np.where(spread > 1e-12 * (1 + every.mean(axis=0) ** 2), spread, 1.0))
        def z(a, mean=every.mean(axis=0), scale=scale):
            return np.column_stack([np.clip((a - mean) / scale, -8, 8), np.ones(len(a))])
        views.append([z(x), z(more), np.zeros(x.shape[1] + 1)])
    labels = [np.full(len(pool[0]), -1), np.full(len(pool[0]), -1)]  # what a view was given

    def fit():
        for _ in range(60):
            for i, view in enumerate(views):
                at = labels[i] >= 0
                z = np.vstack([view[0], view[1][at]])
                t = np.concatenate([y, labels[i][at]])
                p = sigmoid(z @ view[2])
                ridge = np.full(z.shape[1], 1e-3)
                ridge[-1] = 1e-9
                curve = (z * (p * (1 - p))[:, None]).T @ z / len(z) + np.diag(ridge + 1e-9)
                step = np.linalg.solve(curve, z.T @ (p - t) / len(z) + ridge * view[2])
                view[2] = view[2] - step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))

    fit()
    for _ in range(ROUNDS):
        logits = [view[1] @ view[2] for view in views]
        for i in (0, 1):
            new = (np.abs(logits[1 - i]) >= np.log(SURE / (1 - SURE))) & (labels[i] < 0)
            labels[i][new] = logits[1 - i][new] > 0
        fit()
    return views, [int((part >= 0).sum()) for part in labels]


def test_rounds_against_brute_force(spark):
    docs = docs_of(spark, "concat('s', if(id % 2 = 0, id % 6, 6 + id % 7))", 1500)
    x, m = whole(docs.where("doc_id < 120"))
    free = cotraining._features(docs).where("doc_id >= 120").select("x", "m")
    held = free.collect()
    pool = cotraining._both([bytes(r[0]) for r in held], [bytes(r[1]) for r in held])
    y = np.array([1.0 - i % 2 for i in range(120)])
    y[:9] = 1 - y[:9]  # some wrong labels, so that weights stay finite
    views, given = co_train(x, m, y, free)
    want, counts = brute([x, m], y, pool)
    assert given == counts and min(given) > 500
    for view, (_, z, weights) in zip(views, want, strict=True):
        assert np.abs(z @ view.weights - z @ weights).max() < 0.05


def test_500_sources_are_500_values(spark):
    docs = docs_of(spark, "concat('source', id % 500)", 4000)
    _, m = whole(docs)
    columns = {tuple(np.flatnonzero(row[:-17])) for row in m}
    assert len(columns) == 500 and m.shape[1] == 1 + 500 + 17
    labels = docs.selectExpr("doc_id", "cast(doc_id % 500 < 250 AS int) AS quality").where("doc_id < 2000")
    same = docs.withColumns({"text": F.lit("the same"), "n_chars": F.lit(8).cast("long")})
    scores = {r.doc_id: r.predicted for r in score_quality(same, labels).collect()}
    assert np.mean([scores[i] == (i % 500 < 250) for i in range(2000, 4000)]) > 0.95


def test_more_values_than_columns_share_some(spark, monkeypatch):
    monkeypatch.setattr(cotraining, "VALUES", 8)
    _, m = whole(docs_of(spark, "if(id % 2 = 0, 'much', concat('rare', id))", 300))
    assert m.shape[1] == 1 + 8 + cotraining.SHARED + 17 and (m.sum(axis=1) == 3).all()


def test_values_that_differ_after_byte_256(spark):
    docs = docs_of(spark, "concat(repeat('x', 300), id % 2)", 400)
    _, m = whole(docs)
    assert m.shape[1] == 1 + 2 + 17
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS quality").where("doc_id < 200")
    same = docs.withColumns({"text": F.lit("the same"), "n_chars": F.lit(8).cast("long")})
    assert all(r.predicted == r.doc_id % 2 for r in score_quality(same, labels).collect())


def test_null_values_have_columns_of_their_own(spark):
    docs = docs_of(spark, "if(id % 3 = 0, NULL, concat('', id % 3))", 30, lang="cast(NULL AS string)")
    assert whole(docs)[1].shape[1] == 1 + 3 + 17


def test_words_are_not_cut_at_megabytes():
    text = "ab " * 1_500_000
    odd = content(text)
    assert odd[8] == 1 / 1_500_000 and odd[10] == 1.0  # one distinct word, all words the same
