"""Continuous ingest: new records of a stream that no earlier batch has registered."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.operators.dedup import first_wins, registered


def earlier(spark: SparkSession, known: str, number: int) -> DataFrame:
    """Identifiers of the batches before ``number``: one scan, pruned by batch, however many there are."""
    try:
        return spark.read.schema("field_name string, field_value string, batch long").parquet(known).where(F.col("batch") < number).drop("batch")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "field_name string, field_value string")


def ingest(stream: DataFrame, out: str, known: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append first-wins records of ``stream`` (source_idx, rec_idx, fields) to ``out`` and their identifiers to ``known``.

    Each batch writes its own folder of both tables, so a batch that is run again replaces what it wrote before.
    """

    def one(batch: DataFrame, number: int) -> None:
        kept = first_wins(batch, known=earlier(batch.sparkSession, known, number))
        kept.write.mode("overwrite").parquet(f"{out}/batch={number}")
        registered(kept).write.mode("overwrite").parquet(f"{known}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
