"""File sources and sinks.

Readers always take a declared ``StructType`` (no inference job, no type drift
between files); sinks write through the DataFrame writer so every executor
writes its own partition files in parallel — nothing is collected to the driver.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpoint_dir


def read_csv(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",",
             header: bool = True, row_cap: int | None = None) -> DataFrame:
    """CSV scan with a declared schema and optional delimiter. ``row_cap`` is for
    a look at a file: the caller's own limit, which no registered query sets."""
    rows = (spark.read.schema(schema).option("header", header).option("sep", sep)
            .option("mode", "PERMISSIVE").csv(path))
    return rows if row_cap is None else rows.limit(row_cap)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists (a file listing through the public reader API)."""
    try:
        spark.read.format("text").load(path)
        return True
    except AnalysisException:
        return False


def read_csv_or_empty(spark: SparkSession, path: str, schema: StructType | str, sep: str = ";") -> DataFrame:
    """S3: custom-delimiter CSV; an empty frame with the schema when the path is absent."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return read_csv(spark, path, schema, sep=sep)


def schema_only(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "csv") -> DataFrame:
    """header/schema-only scan (zero rows, no data job)."""
    return spark.read.schema(schema).option("header", True).format(fmt).load(path).limit(0)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Parquet sink (overwrite)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    """CSV sink with header for BI tools (one file set per partition)."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A location under the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}"


def input_fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the path, size and time of every file below ``paths``: equal only
    while no input was rewritten, added or removed. Lists files, reads no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    n, total = files.select(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h")).agg(
        F.count("h"), F.coalesce(F.sum("h"), F.lit(0))).first()
    return f"{n}-{int(total) % 2 ** 64:016x}"


def materialize_or_reuse(spark: SparkSession, path: str, build) -> DataFrame:
    """Read the table at ``path`` when it exists, else build, write and read back.
    Where inputs can change, put their ``input_fingerprint`` in the path."""
    if not _exists(spark, path.rstrip("/") + "/_SUCCESS"):      # absent or an interrupted write
        write_parquet(build(), path)
    return spark.read.parquet(path)


def write_metrics(df: DataFrame, path: str) -> str:
    """Evaluation metrics as JSON lines (one small file)."""
    df.coalesce(1).write.mode("overwrite").json(path)
    return path


def save_model(model, path: str) -> str:
    """MLlib ``PipelineModel`` persistence (replaces pickling)."""
    model.write().overwrite().save(path)
    return path
