"""Written intermediate tables, and this package's code on the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for written tables that the driver and all executors see.

    ``spark.checkpoint.dir`` names it. Only a local master may go without: it
    gets a temporary folder of its own. A cluster without the setting is an
    error, since a machine-local folder would not be seen by other executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="martlens-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, its lineage cut.

    A lost executor costs the running tasks only, as the files stay.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ship(spark: SparkSession) -> None:
    """Send the library's code to the executors, once per application."""
    context = spark.sparkContext
    if getattr(context, "_martlens_llm_shipped", False):
        return
    library = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="martlens-code-")) / "martlens_llm.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(library.rglob("*.py")):
            archive.write(path, f"{library.name}/{path.relative_to(library)}")
    context.addPyFile(str(target))
    context._martlens_llm_shipped = True
