"""One local session and small hand-made marts."""

from __future__ import annotations

import sys
from datetime import date
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from martlens.model import NORMALIZED, STAR, Mart, Normalized  # noqa: E402
from martlens.session import local_session  # noqa: E402

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = local_session("martlens-tests", 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf001():
    return str(TESTDATA / "sf0.01")


@pytest.fixture(scope="session")
def sf0001():
    return str(TESTDATA / "sf0.001")


def day_row(text: str) -> tuple:
    day = date.fromisoformat(text)
    return (int(text.replace("-", "")), day, day.month, day.year)


@pytest.fixture
def make_mart(spark):
    """A mart in which the tables not given are empty."""

    def make(**rows: list[tuple]) -> Mart:
        return Mart({name: spark.createDataFrame(rows.get(name, []), STAR[name]) for name in STAR})

    return make


@pytest.fixture
def make_normalized(spark):
    def make(**rows: list[tuple]) -> Normalized:
        return Normalized(
            {
                name: spark.createDataFrame(rows.get(name, []), ddl)
                for name, ddl in NORMALIZED.items()
            }
        )

    return make


def tuples(df) -> list[tuple]:
    return [tuple(row) for row in df.collect()]


def plan_of(df) -> str:
    """The executed plan as text, after adaptive execution where it ran."""
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def all_tasks(spark):
    """Small results stay in as many partitions as large ones, and plans name whole paths."""
    settings = {
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.maxMetadataStringLength": "100000",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
