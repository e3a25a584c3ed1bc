"""Session settings the operators count on."""

from __future__ import annotations

import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows here are small and their checks are work, so small shuffles keep their tasks.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM never compiles a method beyond this size; long lists of checks then go in several methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session (all of them can change at run time)."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    A private folder is used only where none is set and all runs in one process.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative result with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, for wide results that are read several times by few columns.

    It takes less room than a checkpoint, and Spark knows its size, so that small ones are broadcast.
    What this function has returned is such a table and is not written again.
    """
    if getattr(df, "_landledger_stored", False):
        return df
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path, compression="zstd")
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._landledger_stored = True
    return table


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    Workers on other machines (or started from another folder) cannot import it
    otherwise; the driver serves the archive to them.
    """
    context = spark.sparkContext
    if getattr(context, "_landledger_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(package.rglob("*.py")):
            bundle.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._landledger_shipped = True


def pickle_by_value(*modules: str) -> None:
    """Send the classes of these modules along with the query.

    A stateful processor is also started next to the driver, where shipped archives are
    not on the path.
    """
    for name in modules:
        cloudpickle.register_pickle_by_value(sys.modules[name])
