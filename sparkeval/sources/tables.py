"""Scans with the columns checked when the plan is made, not when the rows arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPLETIONS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("problem_id", T.StringType()),
        T.StructField("sample_idx", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the named columns; the scan reads no others. Raises ``ValueError`` if one is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")
    return df.select(*columns)


def read_corpus(
    spark: SparkSession, path: str, required: list[str], format: str = "parquet"
) -> DataFrame:
    return require(spark.read.format(format).load(path), required)


def read_completions(
    spark: SparkSession, path: str, streaming: bool = False, schema: T.StructType = COMPLETIONS
) -> DataFrame:
    """Completions as a table, or as a stream of the files that arrive in the folder."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).parquet(path)


def stream_table(spark: SparkSession, folder: str, file: str, schema: T.StructType) -> DataFrame:
    """One file of a folder as a stream. A time without a zone cannot be watermarked: it becomes a
    timestamp in the session's time zone."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)
    times = [f.name for f in schema if isinstance(f.dataType, T.TimestampNTZType)]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in times})
