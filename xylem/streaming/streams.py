"""Streams of documents: stateless projections, and windowed counts over them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def run_available(stream: DataFrame, each: Callable[[DataFrame], DataFrame], name: str, checkpoint: str, path: str | None = None) -> StreamingQuery:
    """Runs a stateless operator over all that is there now, into a memory table or a folder of Parquet."""
    writer = each(stream).writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if path:
        return writer.format("parquet").option("path", path).outputMode("append").start()
    return writer.format("memory").queryName(name).outputMode("append").start()


def windowed_counts(stream: DataFrame, time: str, keys: list[str], window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Documents by window of time and keys; rows later than ``late`` are left out and their state goes."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n"))


def register(spark: SparkSession) -> None:
    """Makes the scan callable from SQL: ``xml_ok(content)``, and ``xml_events_of(content)`` as a table function."""
    from pyspark.sql.functions import pandas_udf, udtf

    from xylem.operators.scanner import XmlError, scan

    def ok(content: pd.Series) -> pd.Series:
        def one(data) -> bool | None:
            if data is None:
                return None
            try:
                for _ in scan(bytes(data)):
                    pass
            except (XmlError, ValueError):
                return False
            return True

        return content.map(one)

    class Events:
        def eval(self, content: bytes):
            if content is None:
                return
            try:
                found = list(scan(bytes(content)))
            except (XmlError, ValueError):
                return
            for e in found:
                yield e.seq, e.event, e.depth, e.name, e.text

    spark.udf.register("xml_ok", pandas_udf(ok, "boolean"))
    spark.udtf.register("xml_events_of", udtf(Events, returnType="seq int, event string, depth int, name string, text string"))
