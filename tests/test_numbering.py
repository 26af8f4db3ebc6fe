from martlens.operators.numbering import numbered, tagged


def test_rows_of_all_tasks_get_numbers_without_gaps(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 7).selectExpr("id * 3 AS id", "'x' AS tag_task")
    path = str(tmp_path / "tagged")
    tagged(rows.drop("tag_task").where("id % 5 <> 0"), "tag").write.parquet(path)
    found = numbered(spark.read.parquet(path), "tag", "n", 10)
    assert found.columns == ["id", "n"]
    got = found.collect()
    assert sorted(r.n for r in got) == list(range(10, 10 + len(got))) and len(got) == 800
    assert len({r.id for r in got}) == 800
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, got))


def test_no_rows_no_numbers(spark, tmp_path):
    path = str(tmp_path / "tagged")
    tagged(spark.range(0), "tag").write.parquet(path)
    assert numbered(spark.read.parquet(path), "tag", "n").count() == 0
