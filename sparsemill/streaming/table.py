"""A parameter table that lives in a stream: operations come in, changed keys go out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.params import INC, PUSH
from ..shared import fresh_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "key long, seq long, value double"


class KeyedTable(StatefulProcessor):
    """Holds a key's value. In a batch, its operations are taken in order of seq; the state after the last one is emitted, with a null value for a key that is gone."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("value", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        ops = pd.concat(list(rows)).sort_values("seq")
        value = self.state.get()[0] if self.state.exists() else None
        for op, delta in zip(ops["op"], ops["value"], strict=True):
            if op == PUSH:
                value = delta
            elif op == INC:
                value = None if value is None else value + delta
            else:
                value = None
        if value is None:
            self.state.clear()
        else:
            self.state.update((value,))
        yield pd.DataFrame({"key": [key[0]], "seq": [ops["seq"].iloc[-1]], "value": pd.Series([value], dtype="float64")})

    def close(self) -> None:
        pass


def changes(ops: DataFrame) -> DataFrame:
    """The changes (key, seq, value) of a stream of operations (key long, seq long, op string, value double)."""
    return ops.groupBy("key").transformWithStateInPandas(statefulProcessor=KeyedTable(), outputStructType=CHANGES, outputMode="Append", timeMode="None")


def table(changed: DataFrame) -> DataFrame:
    """The table that all changes so far leave."""
    last = changed.groupBy("key").agg(F.max(F.struct("seq", "value")).alias("last"))
    return last.where("last.value IS NOT NULL").select("key", "last.value")


def run_available(spark: SparkSession, ops: DataFrame) -> DataFrame:
    """Runs the stream over what is there now, and gives the table. Changes and checkpoint go to the shared folder."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        out = fresh_path(spark, "changes")
        query = changes(ops).writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, "stream")).outputMode("append").trigger(availableNow=True)
        query.start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return table(spark.read.schema(CHANGES).parquet(out))
