"""Streams of documents: the rules of de-identification and understanding on rows as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardloom.functions.scalars import with_worked_out
from wardloom.plans import understand
from wardloom.plans.protect import judged, output
from wardloom.plans.understand import script_language


def arriving(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of Parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def once(df: DataFrame, key: str, arrived: str, late: str = "1 day") -> DataFrame:
    """Each key once: redelivered rows that arrive within ``late`` of each other are dropped."""
    return df.withWatermark(arrived, late).dropDuplicatesWithinWatermark([key])


def protected(df: DataFrame, profile: str, text: str = "text") -> DataFrame:
    """``df`` with ``protected``, ``safe`` and ``language``: row by row, without state, by the rules and in the way of batches."""
    t = F.col(text)
    out = with_worked_out(judged(df, text, name="_found"), _out=F.when(t.isNotNull(), output(t, F.col("_found"), profile)))
    return out.withColumn("protected", F.col("_out.protected")).withColumn("safe", F.col("_out.safe")).withColumn("language", script_language(t)).drop("_found", "_out")


def understood(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``classification`` and ``route``, row by row."""
    out = understand.understood(df, text).drop("sections", "signals", "scores")
    return out.withColumn("route", understand.routing(F.col("classification.document_type"), F.col("classification.confidence_band")))


def latest(df: DataFrame, key: str, touched: str, kept: int = 32) -> DataFrame:
    """The ``kept`` rows that were touched last, one a key: what a bounded store of documents holds. A top-k, so no row is numbered by one task."""
    last = df.groupBy(key).agg(F.max(touched).alias(touched), F.max_by(F.struct(*[c for c in df.columns if c not in (key, touched)]), touched).alias("_row"))
    return last.orderBy(F.desc(touched), key).limit(kept).select(key, touched, "_row.*")


def written(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start to write a stream as Parquet; with ``available_now`` it ends when all there is is written."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w).start()
