"""Tables kept as parquet: loading, saving, and one build per session."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.model import (
    NORMALIZED,
    PERIOD_COLUMNS,
    STAR,
    STAR_KEYS,
    Mart,
    Normalized,
    checked,
    conform,
    duplicate_keys,
)
from martlens.session import once_per_session, shared_folder


def load_mart(spark: SparkSession, path: str, partitioned: bool = True) -> Mart:
    """A mart saved by ``save_mart``; facts are partitioned by year and month.

    A table with a missing or mistyped column raises when it is first used.
    """

    def load(name: str) -> DataFrame:
        fact = partitioned and name.startswith("fakta_")
        ddl = f"{STAR[name]}, {PERIOD_COLUMNS}" if fact else STAR[name]
        return checked(spark.read.parquet(f"{path.rstrip('/')}/{name}"), ddl, name)

    tables = {name: (lambda name=name: load(name)) for name in STAR}
    for name in Mart.derived:
        try:
            tables[name] = spark.read.parquet(f"{path.rstrip('/')}/{name}")
        except AnalysisException:  # saved without it: worked out when asked for
            continue
    return Mart(tables)


def load_normalized(spark: SparkSession, path: str) -> Normalized:
    """Normalized tables stored as one parquet folder each, checked like a mart's."""

    def load(name: str) -> DataFrame:
        table = spark.read.parquet(f"{path.rstrip('/')}/{name}")
        return checked(table, NORMALIZED[name], name)

    return Normalized({name: (lambda name=name: load(name)) for name in NORMALIZED})


def resolve_table(spark: SparkSession, *names: str) -> DataFrame:
    """The first of ``names`` that the catalog has."""
    for name in names:
        if spark.catalog.tableExists(name):
            return spark.table(name)
    raise ValueError(f"none of {list(names)} exists")


def mart_from_catalog(spark: SparkSession, prefix: str = "") -> Mart:
    """A mart whose tables are found by name in the session catalog.

    ``prefix`` may name a catalog and database (``pg.public.``), which covers
    tables served over JDBC. The seller dimension may go by either name.
    """
    aliases = {"dim_seller": ("dim_seller", "dim_penjual")}

    def find(name: str) -> DataFrame:
        names = [prefix + alias for alias in aliases.get(name, (name,))]
        table = resolve_table(spark, *names)
        partitioned = name.startswith("fakta_") and {"tahun", "bulan"} <= set(table.columns)
        return conform(table, f"{STAR[name]}, {PERIOD_COLUMNS}" if partitioned else STAR[name])

    return Mart({name: (lambda name=name: find(name)) for name in STAR})


def register_views(tables: Mart | Normalized, prefix: str = "") -> None:
    """Expose tables to SQL; the normalized ones go by the prefix ``n_``."""
    prefix = prefix or ("n_" if isinstance(tables, Normalized) else "")
    for name in tables.names():
        tables.table(name).createOrReplaceTempView(prefix + name)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Write parquet; with ``by``, into one folder per value.

    The rebalance hint gathers the rows of a folder and lets adaptive
    execution cut a folder that outgrows the advisory partition size, so a
    month holding a third of all rows becomes many files, not one long task.
    """
    if by:
        df = df.hint("rebalance", *by)
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def check_keys(mart: Mart) -> None:
    """Raise, with names, if a dimension has a NULL key or one for several rows."""
    for name, key in STAR_KEYS.items():
        dim = mart.table(name)
        wrong = [row[0] for row in duplicate_keys(dim, key).orderBy(key).limit(5).collect()]
        if not dim.where(F.col(key).isNull()).isEmpty():
            wrong.append(None)
        if wrong:
            raise ValueError(f"{name}: {key} {wrong} stand for several rows or none")


def _facts_by(mart: Mart, name: str) -> list[str]:
    fact = name.startswith("fakta_")
    return [c for c in ("tahun", "bulan") if fact and c in mart.table(name).columns]


def save_mart(mart: Mart, path: str, partitioned: bool = True) -> None:
    """Write every table of a mart under ``path``, facts by year and month.

    Facts that are not to be partitioned are written in the order of their date
    key, without year and month, so that a period reads few of their files. The
    dimensions' keys are checked first.

    The joined order lines, from which two facts and their sums derive, are
    written once, under ``_staged`` in ``path``; that folder may go afterwards.
    """
    path = path.rstrip("/")
    check_keys(mart)

    def store(name: str, table: DataFrame) -> DataFrame:
        at = f"{path}/_staged/{name}-{uuid4().hex}"
        table.write.parquet(at)
        return table.sparkSession.read.schema(table.schema).parquet(at)

    mart = mart.staged(store)
    for name in STAR:
        df, by = mart.table(name), _facts_by(mart, name)
        if by and not partitioned:
            df = df.drop(*by).repartitionByRange("waktu_id").sortWithinPartitions("waktu_id")
            by = []
        write_partitioned(df, f"{path}/{name}", by)
    for name in filter(mart.has, Mart.derived):
        write_partitioned(mart.table(name), f"{path}/{name}")


def publish_mart(mart: Mart, path: str, partitioned: bool = True) -> str:
    """Save a mart beside earlier ones and make it the current one at once; its name.

    All tables are complete before one row names the version, so readers of
    ``load_published`` see every table of the old mart or every table of the
    new one, whatever fails in between.
    """
    version, path = f"mart-{uuid4().hex}", path.rstrip("/")
    save_mart(mart, f"{path}/{version}", partitioned)
    spark = mart.dim_waktu.sparkSession
    entry = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at"))
    entry.coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return version


def load_published(spark: SparkSession, path: str, version: str | None = None, partitioned: bool = True) -> Mart:
    """The mart that was published last, or the named one."""
    path = path.rstrip("/")
    if version is None:
        last = spark.read.schema("version string, at timestamp").parquet(f"{path}/versions")
        version = last.orderBy(F.col("at").desc(), "version").first()["version"]
    return load_mart(spark, f"{path}/{version}", partitioned)


def written_once(
    spark: SparkSession,
    source: str,
    name: str,
    derive: Callable[[], DataFrame],
    by: Sequence[str] = (),
) -> DataFrame:
    """``derive()`` as a table written once per session and read back.

    Reading it back gives the optimizer the true file sizes, and a lost
    executor costs a re-read rather than a re-run of the build. The table shows
    ``source`` as it was when first asked for. Without a shared folder the
    plain lazy DataFrame is returned: slower, same rows. The folder
    ``martlens-<application id>`` may go when the application has ended;
    ``save_mart`` is for marts that stay.
    """
    return once_per_session(
        spark, ("written", source, name), lambda: _write(spark, name, derive(), by)
    )


def _write(spark: SparkSession, name: str, df: DataFrame, by: Sequence[str]) -> DataFrame:
    folder = shared_folder(spark)
    if folder is None:
        return df
    # A path of its own for each write: sessions of one application never
    # overwrite what another of them is reading.
    application = spark.sparkContext.applicationId
    path = f"{folder}/martlens-{application}/{name}-{uuid4().hex}"
    write_partitioned(df, path, by)
    return spark.read.schema(df.schema).parquet(path)
