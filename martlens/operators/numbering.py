"""Numbers without gaps for the rows of a table of any size.

No window without a partition and no sort: a row's number is its place within
the task that wrote it plus the rows of the tasks before. Only one count per
task is brought together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of ``monotonically_increasing_id`` that count rows within a task.
_ROW_BITS = 33


def tagged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` with the column that ``numbered`` needs; write it before numbering.

    The tag depends on how rows are dealt to tasks, so it has to be stored:
    only then do all readers see the same one.
    """
    return df.withColumn(tag, F.monotonically_increasing_id())


def numbered(stored: DataFrame, tag: str, name: str, start: int = 0) -> DataFrame:
    """``stored`` with numbers ``start``, ``start + 1``, ... in ``name`` instead of the tag.

    Takes a table that was written with ``tagged``, all its rows. The window
    runs over one row per writing task.
    """
    task, rows, before = f"{tag}_task", f"{tag}_rows", f"{tag}_before"
    of_task = F.shiftright(F.col(tag), _ROW_BITS)
    counts = stored.groupBy(of_task.alias(task)).agg(F.count(F.lit(1)).alias(rows))
    earlier = Window.orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(task, F.coalesce(F.sum(rows).over(earlier), F.lit(0)).alias(before))
    place = F.col(tag).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    joined = stored.withColumn(task, of_task).join(offsets, task)
    return joined.withColumn(name, place + F.col(before) + F.lit(start)).drop(tag, task, before)
