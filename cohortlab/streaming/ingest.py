"""Op 110: streaming ingest of response files, each (run, id) taken once.

Files land in a folder; a Structured Streaming query parses them (op 66) and hands each
micro-batch to a keyed sink (``streaming/sink.py``) as one delivery. The delivery's token is
the stream's own id, which its checkpoint keeps, with the micro-batch's number: a retried or restarted
stream repeats no delivery, and a stream with a new checkpoint adds to what the sink holds. The first
delivery of a (run, id) wins, however late a repeat comes (no watermark, no state
that grows). ``availableNow`` processes what is there and stops, so the same job
serves as an incremental batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.operators.prompts import parse_response
from cohortlab.sources.io import RESPONSE_RECORD
from cohortlab.streaming.sink import KeyedSink

STREAM_RECORD = T.StructType(RESPONSE_RECORD.fields + [T.StructField("received_at", T.TimestampType())])
KEYS = ["run", "id"]
SINK_RECORD = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("id", T.LongType()),
    T.StructField("think", T.StringType()), T.StructField("pred", T.DoubleType()), T.StructField("status", T.StringType()),
    T.StructField("label", T.DoubleType())])


def response_stream(spark: SparkSession, source: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Parsed responses as they come."""
    raw = (spark.readStream.schema(STREAM_RECORD).option("maxFilesPerTrigger", max_files_per_trigger)
           .json(source))
    return parse_response(raw.select("run", "id", "response", "label", "received_at"), "response")


def response_sink(spark: SparkSession, path: str, **params) -> KeyedSink:
    return KeyedSink(spark, path, SINK_RECORD, KEYS, **params)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Structured Streaming wrote into a checkpoint when its stream began."""
    text = "".join(r.value for r in spark.read.text(f"{checkpoint}/metadata").collect())  # one line
    return spark.range(1).select(F.get_json_object(F.lit(text), "$.id")).first()[0]


def first_received(batch: DataFrame) -> DataFrame:
    """One row per (run, id) of a micro-batch: the record received first (then the smallest response text)."""
    return (batch.groupBy(*KEYS).agg(F.min(F.struct("received_at", "response", "think", "pred", "status", "label")).alias("r"))
            .select(*KEYS, "r.think", "r.pred", "r.status", F.col("r.label").cast("double").alias("label")))


def ingest_available(spark: SparkSession, source: str, sink: str, checkpoint: str,
                     max_files_per_trigger: int = 1000, **params) -> DataFrame:
    """Run the stream over all files present now, then return the sink as a table."""
    store = response_sink(spark, sink, **params)

    def deliver(batch: DataFrame, number: int) -> None:
        store.deliver(first_received(batch), f"{stream_id(spark, checkpoint)}-{number}")

    q = (response_stream(spark, source, max_files_per_trigger).writeStream.foreachBatch(deliver)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return store.read()
