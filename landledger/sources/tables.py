"""Reading tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landledger import fixed
from landledger.functions.text import mapped, quoted


def scan_tables(spark: SparkSession, path: str, columns: list[str], where: str | None = None, format: str = "parquet", **options) -> DataFrame:
    """Chosen columns of the rows that qualify; columns and filter reach the scan.

    ``format`` may be any Spark source, including jdbc.
    """
    reader = spark.read.format(format).options(**options)
    df = reader.load(path) if path else reader.load()
    return (df if where is None else df.filter(where)).select(*columns)


def judge_intake(files: DataFrame) -> DataFrame:
    """accepted and reason for files with path and length, by type and size."""
    extension = "lower(regexp_extract(path, '([.][^./]*)$', 1))"
    kind = mapped(extension, fixed.ACCEPTED_TYPES)
    top = fixed.MAX_UPLOAD_BYTES
    return files.withColumn("mime_type", F.expr(kind)).withColumn(
        "reason",
        F.expr(
            f"case when mime_type is null then concat('Unsupported file type \"', coalesce(nullif({extension}, ''), 'unknown'), "
            f"'\". Accepted: JPG, PNG, PDF.') when length = 0 then 'File is empty' "
            f"when length > {top} then 'File exceeds the {top // 1024 // 1024} MB limit' end"
        ),
    ).withColumn("accepted", F.col("reason").isNull())


def scan_intake(spark: SparkSession, folder: str) -> DataFrame:
    """Files of an upload folder with the verdict on each; contents are not read.

    The file source lists no empty files, so those show only where a manifest of paths
    and lengths is given to :func:`judge_intake`.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        .select("path", "length", "modificationTime")
    )
    return judge_intake(files)


def json_columns(df: DataFrame, schemas: dict[str, tuple[str, str]]) -> DataFrame:
    """Decode JSON text columns; ``schemas`` gives type and default SQL per column."""
    return df.withColumns({
        c: F.expr(f"coalesce(from_json({c}, {quoted(schema)}), {default})") for c, (schema, default) in schemas.items()
    })


def free_json(df: DataFrame, column: str) -> DataFrame:
    """Decode a JSON column without a fixed shape to a variant; null when it is not JSON."""
    return df.withColumn(column, F.try_parse_json(column))
