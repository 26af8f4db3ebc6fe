"""Large groups of near copies cost no more rows than they have sets."""

from pyspark.sql import functions as F

from martlens.llm import components as C
from martlens.llm import jaccard_join as J


def _sets(spark, n):
    """Sets of 148 shingles in one region, whose sketches differ in few bits."""
    rows = spark.range(n).select(
        F.lit(1).cast("long").alias("home"), F.lit(1).cast("long").alias("region"), F.lit(0).alias("side"),
        F.col("id").alias("h"), F.lit(148).cast("long").alias("n"), F.col("id").alias("comp"),
    )
    sketch = F.concat(F.unhex(F.lit("00" * 24)), F.unhex(F.lpad(F.hex("id"), 16, "0")))
    return rows, spark.range(n).select(F.col("id").alias("h"), sketch.alias("sketch"))


def test_a_region_that_no_cut_halves_is_not_copied_into_its_cells(spark):
    rows, sketches = _sets(spark, 120)
    found = J._small_regions(rows, sketches, 90, 40).collect()
    assert len(found) <= 120 * 2 * 120 // 40  # once a block; eight times that in cells before
    by_region = {}
    for r in found:
        by_region.setdefault(r.region, []).append(r)
    met = {
        frozenset((a.h, b.h))
        for held in by_region.values()
        for a in held
        for b in held
        if a.h != b.h and (a.side == 0 or a.side != b.side)
    }
    assert len(met) == 120 * 119 // 2


def test_the_pivot_is_the_set_of_most_documents(spark):
    rows, sketches = _sets(spark, 30)
    rows = rows.select("region", "h", "n", "comp", F.when(F.col("h") == 17, 9).otherwise(1).alias("copies"))
    tested = spark.createDataFrame([], "a long, b long, linked boolean")
    pairs = J._to_pivots(rows, sketches, tested, 90, 0).collect()
    assert len(pairs) == 29 and all(17 in (p.a, p.b) for p in pairs)


def test_regions_of_the_same_sets_are_one(spark):
    rarest = spark.createDataFrame(
        [(s, h) for s in (1, 2, 3) for h in (10, 11, 12)] + [(4, 10), (4, 11), (5, 12)], "sig long, h long"
    )
    classes = spark.createDataFrame([(h, 50, 1) for h in (10, 11, 12)], "h long, n long, copies long")
    found = J._regions(rarest, classes, 90, 8).groupBy("region").count().collect()
    assert sorted(r["count"] for r in found) == [2, 3]


def test_stars_need_no_round(spark, monkeypatch):
    names = []
    plain = C.written
    monkeypatch.setattr(C, "written", lambda df, name: names.append(name) or plain(df, name))
    stars = spark.createDataFrame([(9, 1), (8, 1), (7, 2)], "u long, v long")
    assert sorted(map(tuple, C.components(stars).collect())) == [(1, 1), (2, 2), (7, 2), (8, 1), (9, 1)]
    assert names == ["links"]
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(20, 21), (21, 22)], "u long, v long")
    want = [(i, 0) for i in range(7)] + [(20, 20), (21, 20), (22, 20)]
    assert sorted(map(tuple, C.components(chain).collect())) == want
