"""Positions and documents of results that nothing bounds, and panels side by side."""

import json
import time

from conftest import plan_of, tuples
from pyspark.sql import Window
from pyspark.sql import functions as F

from martlens.operators.ranking import highest_first, ranked
from martlens.plans import leaders
from martlens.plans.build import open_mart
from martlens.plans.panels import run_panels
from martlens.sinks import chart_arrays, json_fragments, write_chart_arrays


def test_positions_of_a_million_labels(spark):
    rows = spark.range(0, 1_000_000, 1, 8).select(
        F.concat(F.lit("L"), F.pmod(F.xxhash64("id"), F.lit(2**40))).alias("label"),
        F.when(F.col("id") % 1000 > 0, F.pmod(F.hash("id"), F.lit(5000))).alias("v"),
    )
    order = highest_first("v")
    found = ranked(rows, order)
    plan = plan_of(found)
    assert "SinglePartition" not in plan.split("Window")[0] and "Exchange SinglePartition" not in plan.replace("Window", "\n").split("\n")[0]
    want = rows.select(F.row_number().over(Window.orderBy(*order)).alias("pos"), "*")
    assert found.count() == 1_000_000
    both = found.withColumn("pos", F.col("pos").cast("int")).exceptAll(want)
    assert both.isEmpty()


def test_positions_take_one_row_per_task_to_one_task(spark, all_tasks):
    stages = spark.sparkContext.statusTracker()
    rows = spark.range(0, 200_000, 1, 8).select(F.concat(F.lit("x"), "id").alias("label"), (F.col("id") % 77).alias("v"))
    spark.sparkContext.setJobGroup("positions", "rows of a ranking")
    try:
        ranked(rows, highest_first("v"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = [stages.getJobInfo(job) for job in stages.getJobIdsForGroup("positions")]
    tasks = [stages.getStageInfo(stage).numTasks for job in jobs for stage in job.stageIds if stages.getStageInfo(stage)]
    assert tasks and min(tasks) > 1


def test_no_rows_have_no_positions(spark):
    assert ranked(spark.createDataFrame([], "label string, v int"), highest_first("v")).count() == 0


def read_document(path) -> str:
    return "".join(part.read_text() for part in sorted(path.glob("part-*")))


def test_an_ordered_document_is_that_of_one_task(spark, sf0001, tmp_path, all_tasks):
    m = open_mart(spark, sf0001)
    boards = {
        "top": leaders.top_items(m),
        "odd": spark.createDataFrame(
            [(1, 'a "quoted"\nline', 5), (2, None, None), (3, "é", 7)], "pos int, label string, total_qty long"
        ),
        "none": leaders.top_items(m).limit(0),
    }
    for name, board in boards.items():
        want = chart_arrays(board, "label", "total_qty").first().document
        write_chart_arrays(board, str(tmp_path / name), "label", "total_qty")
        text = read_document(tmp_path / name)
        assert text.replace("\n", "") == want, name
    places = leaders.seller_positions(m)
    assert "collect_list" not in plan_of(json_fragments(places, "label", "total_qty"))
    write_chart_arrays(places.repartition(7), str(tmp_path / "all"), "pos", "label", "total_revenue")
    found = json.loads(read_document(tmp_path / "all"))
    assert list(zip(found["pos"], found["label"], found["total_revenue"])) == [
        (r.pos, r.label, r.total_revenue) for r in places.orderBy("pos").collect()
    ]
    assert len(list((tmp_path / "all").glob("part-*"))) > 1


def test_a_slow_panel_is_cancelled_and_a_failing_one_fails_alone(spark):
    slow = spark.range(0, 8, 1, 8).selectExpr("sum(aggregate(sequence(1, 200000000), 0L, (a, b) -> a + b))")
    begun = time.monotonic()
    panels = run_panels(
        {
            "slow": lambda: slow,
            "broken": lambda: spark.table("no_such_table"),
            "good": lambda: spark.range(3),
            "later": lambda: spark.range(4),
        },
        seconds=4,
        at_once=2,
    )
    assert list(panels) == ["slow", "broken", "good", "later"]
    assert "cancelled" in panels["slow"].error and panels["slow"].rows == []
    assert "no_such_table" in panels["broken"].error
    assert tuples(spark.range(3)) == [tuple(r) for r in panels["good"].rows] and len(panels["later"].rows) == 4
    assert time.monotonic() - begun < 60


def test_panels_run_side_by_side(spark):
    def asleep():
        time.sleep(1.5)
        return spark.range(1)

    begun = time.monotonic()
    panels = run_panels({f"p{i}": asleep for i in range(4)})
    assert all(len(panel.rows) == 1 for panel in panels.values())
    assert time.monotonic() - begun < 5.5
