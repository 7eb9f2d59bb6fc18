"""Structured Streaming: documents that keep arriving.

Each micro-batch of documents becomes one segment of postings; frequencies are
additive, so readers sum segments.  Term counts per event-time window are a
stateful aggregation with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import TokenizerConfig
from ..functions.analysis import analyze
from ..operators.tables import document_tokens, postings


def ingest(
    stream: DataFrame, folder: str, config: TokenizerConfig = TokenizerConfig(), *,
    available_now: bool = True,
) -> StreamingQuery:
    """Writes postings and document lengths of ``stream(doc_id, text)`` by segment.

    A batch that is retried overwrites its own segment, so every document counts
    once.
    """

    def segment(batch: DataFrame, number: int) -> None:
        docs = document_tokens(batch.select("doc_id", "text"), config).persist()
        docs.select("doc_id", "doc_len").write.mode("overwrite").parquet(f"{folder}/docs/segment={number}")
        postings(docs).write.mode("overwrite").parquet(f"{folder}/postings/segment={number}")
        docs.unpersist()

    writer = stream.writeStream.foreachBatch(segment).option("checkpointLocation", f"{folder}/_progress")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def segments(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents, postings) of all segments written so far."""
    return (
        spark.read.parquet(f"{folder}/docs").drop("segment"),
        spark.read.parquet(f"{folder}/postings").drop("segment"),
    )


def windowed_terms(
    stream: DataFrame, config: TokenizerConfig = TokenizerConfig(), *, time: str = "ts",
    text: str = "text", window: str = "1 hour", slide: str | None = None, late: str = "10 minutes",
) -> DataFrame:
    """(window_start, term, n): term counts by event time; later rows than ``late`` drop."""
    tokens = analyze(stream.select(time, text).withWatermark(time, late), config, text)
    frame = F.window(F.col(time), window, slide) if slide else F.window(F.col(time), window)
    return (
        tokens.select(time, F.explode("tokens").alias("term"))
        .groupBy(frame.alias("w"), "term").agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "term", "n")
    )
