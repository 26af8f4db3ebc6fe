"""Session settings and the shared folder for written tables."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Hashable
from dataclasses import dataclass, field
from threading import Lock, RLock
from typing import TypeVar
from uuid import uuid4
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

@dataclass
class _Slot:
    """What was made for one key, and the lock of those who wait for it."""

    lock: RLock = field(default_factory=RLock)
    made: list = field(default_factory=list)


_finding = Lock()
_remembered: WeakKeyDictionary[SparkSession, dict[Hashable, _Slot]] = WeakKeyDictionary()


def once_per_session(spark: SparkSession, key: Hashable, make: Callable[[], T]) -> T:
    """What ``make()`` returned the first time this session asked for ``key``.

    Used for opened tables, so that files are listed and their footers read
    once and not by each query. Threads that ask for other keys do not wait.
    """
    with _finding:
        slot = _remembered.setdefault(spark, {}).setdefault(key, _Slot())
    with slot.lock:
        if not slot.made:
            slot.made.append(make())
        return slot.made[0]


def local_session(app: str, cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench run."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str | None:
    """Where this application may write tables that all executors can read.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    local master gets a fresh folder of its own; a cluster gets none, since a
    machine-local folder would not be seen by the other executors.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        return None
    context.setCheckpointDir(tempfile.mkdtemp(prefix="martlens-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own for a table that this application writes."""
    folder = shared_folder(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{folder}/martlens-{spark.sparkContext.applicationId}/{name}-{uuid4().hex}"


def stored_copy(df: DataFrame, name: str) -> DataFrame:
    """``df`` written now and read back: computed once, the same rows for every reader."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
