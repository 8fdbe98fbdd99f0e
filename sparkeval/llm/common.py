"""What the operators share: columns computed batch by batch, and names that clash with no other."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sparkeval.plans.session import materialize

# Texts in one Arrow batch. It bounds the memory of a Python worker; it changes no result.
ROWS_PER_BATCH = 256
SHINGLE_WORDS = 5
TASKS_PER_CORE = 4


def prepared(spark: SparkSession) -> SparkSession:
    """Batches by a number of rows that suits long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    return spark


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (names have no case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fewer(df: DataFrame) -> DataFrame:
    """The same rows in at most ``TASKS_PER_CORE`` tasks for each core of the session, for a pass that
    hands on one summary per task: summaries then grow with the cluster, not with the input."""
    return df.coalesce(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` by ``fewer`` tasks and so in few files: a step of many joins stores many small tables,
    and each would cost a task and a file for every partition of the session's shuffles."""
    return materialize(fewer(df), name)


def append(
    df: DataFrame, into: str, kind: T.StructType, rows: Callable[[dict[str, list]], list[tuple]], reads: list[str]
) -> DataFrame:
    """Add the struct column ``into``; a column of that name is replaced, as ``withColumn`` does.

    ``rows`` gets the values of the columns ``reads`` for a batch and returns a tuple per row. It runs
    once per row, whatever is selected afterwards. Select the columns you need before: all others pass
    through Python.
    """
    fields = [arrow_type(f.dataType) for f in kind]

    def arrays(columns: dict[str, pa.Array]) -> list[pa.Array]:
        found = rows({c: values.to_pylist() for c, values in columns.items()})
        return [pa.array([r[i] for r in found], type=t) for i, t in enumerate(fields)]

    return append_arrays(df, into, kind, arrays, reads)


def append_arrays(
    df: DataFrame, into: str, kind: T.StructType, arrays: Callable[[dict[str, pa.Array]], list[pa.Array]], reads: list[str]
) -> DataFrame:
    """``append`` for a function of whole Arrow columns, which gives an array per field."""
    if into.lower() in {c.lower() for c in df.columns} - {c.lower() for c in reads}:
        df = df.drop(into)
    elif into.lower() in {c.lower() for c in reads}:
        raise ValueError(f"{into} is read")
    names = [f.name for f in kind]
    places = {c: df.columns.index(c) for c in reads}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added = pa.StructArray.from_arrays(arrays({c: batch.column(i) for c, i in places.items()}), names=names)
            yield pa.RecordBatch.from_arrays([*batch.columns, added], names=[*batch.schema.names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, kind)]))


SIMPLE = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
}


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    return {
        "string": pa.string(),
        "bigint": pa.int64(),
        "int": pa.int32(),
        "double": pa.float64(),
        "boolean": pa.bool_(),
        "binary": pa.binary(),
    }[kind.simpleString()]


def struct(**kinds: str) -> T.StructType:
    """A struct of columns of simple types, or of arrays of them."""

    def of(kind: str) -> T.DataType:
        return T.ArrayType(of(kind[6:-1])) if kind.startswith("array<") else SIMPLE[kind]

    return T.StructType([T.StructField(n, of(k)) for n, k in kinds.items()])


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
