"""Moving averages and newest rows in a keyed state store: a micro-batch writes the keys that it touches.

State lies in RocksDB, one entry per key, and its changes are logged per micro-batch below the query's
checkpoint. The states are read back with Spark's own reader of state stores. Keys are handled in
``BUCKETS`` groups, each with a map of its keys, as a call per key costs far more than its rows.

``stream_ema`` and ``stream_last_n`` of the neighbouring module keep states as tables instead. They suit a
few very long series, which the batch operators cut into ranges; these here suit very many keys.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from heapq import nlargest
from itertools import islice
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sparkeval.operators.selection import last_n
from sparkeval.streaming.tables import changes_to, start

STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
SHARE = "_share"
BUCKET = "_bucket"
BUCKETS = 4096
CHUNK = 10_000
HOT_ROWS = 16
MICROS = "__us"


def _stored(spark: SparkSession) -> None:
    for key, value in STORE.items():
        spark.conf.set(key, value)


def _bucket(columns: list[str]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int").alias(BUCKET)


def _times(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if isinstance(f.dataType, T.TimestampType)]


def _plain(df: DataFrame) -> DataFrame:
    """Times as microseconds: the same number in the rows that arrive and in the state."""
    return df.withColumns({c: F.unix_micros(c) for c in _times(df.schema)})


def _timed(df: DataFrame, times: list[str]) -> DataFrame:
    return df.withColumns({c: F.timestamp_micros(c) for c in times})


def _marked(schema: T.StructType, times: list[str]) -> T.StructType:
    """The schema of a state, which tells its reader the times."""
    return T.StructType([T.StructField(f.name + MICROS * (f.name in times), f.dataType) for f in schema])


def _read_times(df: DataFrame) -> DataFrame:
    times = [c for c in df.columns if c.endswith(MICROS)]
    return _timed(df, times).withColumnsRenamed({c: c.removesuffix(MICROS) for c in times})


def _place(order: list[str]) -> Callable[[Any], tuple]:
    """Sort key of a row: missing values first."""

    def place(row: Any) -> tuple:
        values = [row[c] for c in order]
        return tuple((1, v) if v is not None and v == v else (0,) for v in values)

    return place


def _by_key(rows: Iterable[Row], keys: list[str]) -> Iterable[tuple[tuple, list[Row]]]:
    found: dict[str, tuple[tuple, list[Row]]] = {}
    for row in rows:
        key = tuple(row[c] for c in keys)
        found.setdefault(repr(key), (key, []))[1].append(row)
    return found.values()


class Ema(StatefulProcessor):
    """The averages of the keys of a bucket, each continued over its rows in order."""

    def __init__(self, keys: T.StructType, order: list[str], value: str, decay: float) -> None:
        self.keys, self.order, self.value, self.decay = keys, order, value, decay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("ema", self.keys, "ema double")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = self.state.exists()
        out: list[Row] = []
        for name, batch in _by_key(rows, [c.removesuffix(MICROS) for c in self.keys.names]):
            held = self.state.getValue(name) if known else None
            out += self._averaged(name, sorted(batch, key=_place(self.order)), held)
        return iter(out)

    def _averaged(self, name: tuple, batch: list[Row], held: tuple | None) -> list[Row]:
        # A missing value counts as 0, a missing first one leaves the key without averages, as in the batch operator.
        ema, averaged, out = held and held[0], Row(*batch[0].__fields__, "ema"), []
        for row in batch:
            x = math.nan if row[self.value] is None else float(row[self.value])
            ema = x if ema is None else self.decay * ema + (1 - self.decay) * (0.0 if math.isnan(x) else x)
            out.append(averaged(*row, None if math.isnan(ema) else ema))
        self.state.updateValue(name, (float(ema),))
        return out

    def close(self) -> None:
        pass


class Newest(StatefulProcessor):
    """The newest ``n`` rows of each key and share of a bucket."""

    def __init__(self, keys: T.StructType, order: list[str], n: int, schema: T.StructType) -> None:
        self.keys, self.order, self.n, self.schema = keys, order, n, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        rows = T.StructType([T.StructField("rows", T.ArrayType(self.schema))])
        self.state = handle.getMapState("rows", self.keys, rows)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known, names = self.state.exists(), [c.removesuffix(MICROS) for c in self.schema.names]
        held, place = Row(*names), _place(self.order)
        newest: dict[str, tuple[tuple, list[Row]]] = {}
        while chunk := list(islice(rows, CHUNK)):  # memory holds n rows of each key and a chunk
            for name, batch in _by_key(chunk, [c.removesuffix(MICROS) for c in self.keys.names]):
                newest[repr(name)] = (name, nlargest(self.n, newest.get(repr(name), (name, []))[1] + batch, key=place))
        for name, batch in newest.values():
            before = self.state.getValue(name) if known else None
            if before:
                batch = nlargest(self.n, [held(*r) for r in before[0]] + batch, key=place)
            self.state.updateValue(name, ([tuple(r[c] for c in names) for r in batch],))
        return iter(())

    def close(self) -> None:
        pass


def _deal(keys: list[str], shares: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keep the share only of keys that hold more than one ``shares``-th of their chunk; the others have one."""

    def deal(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks:
            counts = pa.table([chunk[c] for c in keys], keys).group_by(keys).aggregate([([], "count_all")])
            most = max(HOT_ROWS, chunk.num_rows // shares)
            hot = {repr(tuple(r[c] for c in keys)) for r in counts.filter(pc.field("count_all") > most).to_pylist()}
            at = chunk.schema.get_field_index(SHARE)
            if hot:
                named = zip(*[chunk[c].to_pylist() for c in keys])
                share = [s if repr(k) in hot else 0 for s, k in zip(chunk[SHARE].to_pylist(), named)]
            else:
                share = [0] * chunk.num_rows
            yield chunk.set_column(at, chunk.schema.field(at), pa.array(share, pa.int32()))

    return deal


def stream_ema_state(
    stream: DataFrame,
    path: str,
    keys: list[str],
    order: list[str],
    value: str,
    decay: float = 0.999,
    available_now: bool = True,
) -> StreamingQuery:
    """Moving average per key over a stream, as ``stream_ema`` gives; read the rows with ``appended``.

    The rows of a key in one micro-batch are sorted by ``order`` in memory, so the source has to bound its
    micro-batches (``maxBytesPerTrigger``). Null is a key like any other.
    """
    _stored(stream.sparkSession)
    rows = _plain(stream)
    schema = T.StructType([*rows.schema.fields, T.StructField(BUCKET, T.IntegerType()), T.StructField("ema", T.DoubleType())])
    times = _times(stream.schema)
    processor = Ema(_marked(rows.select(*keys).schema, times), order, value, decay)
    dealt = rows.withColumn(BUCKET, _bucket(keys)).groupBy(BUCKET)
    averaged = _timed(dealt.transformWithState(processor, schema, "Append", "None").drop(BUCKET), times)
    return start(averaged, path, changes_to(path), "append", available_now)


def read_ema_state(spark: SparkSession, path: str) -> DataFrame:
    """(keys, ema): the average of each key after the last micro-batch."""
    return _read_times(_state(spark, path, "ema").select("user_map_key.*", "user_map_value.*"))


def stream_last_n_state(
    stream: DataFrame,
    path: str,
    keys: list[str],
    order: list[str],
    n: int,
    shares: int = 16,
    available_now: bool = True,
) -> StreamingQuery:
    """Newest ``n`` rows per key; read them with ``read_last_n_state``.

    A key that holds more than one ``shares``-th of a chunk of rows has up to ``shares`` states, between which
    its rows are dealt by a hash of ``order``, so a key that fills a third of the stream does not pass through
    one task; other keys have one. Each holds its newest ``n`` rows, and the reader merges them.
    """
    _stored(stream.sparkSession)
    rows = _plain(stream).withColumn(SHARE, F.pmod(F.xxhash64(*order), F.lit(shares)).cast("int"))
    dealt = rows.mapInArrow(_deal(keys, shares), rows.schema).withColumn(BUCKET, _bucket([*keys, SHARE]))
    schema = _marked(rows.schema, _times(stream.schema))
    own = [f for f, c in zip(schema, rows.columns) if c not in (*keys, SHARE)]
    named = _marked(rows.select(*keys, SHARE).schema, _times(stream.schema))
    processor = Newest(named, order, n, T.StructType(own))
    held = dealt.groupBy(BUCKET).transformWithState(processor, "held string", "Append", "None")
    return start(held, path, lambda batch, _: batch.write.format("noop").mode("overwrite").save(), "append", available_now)


def read_last_n_state(spark: SparkSession, path: str, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The newest ``n`` rows of each key after the last micro-batch."""
    held = _state(spark, path, "rows").select("user_map_key.*", F.inline("user_map_value.rows"))
    return last_n(_read_times(held.drop(SHARE)), keys, order, n)


def _state(spark: SparkSession, path: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE["spark.sql.streaming.stateStore.providerClass"])
    return spark.read.format("statestore").option("stateVarName", name).load(f"{path}/checkpoint")
