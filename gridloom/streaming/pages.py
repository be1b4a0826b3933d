"""Page streams: the per-page operators over micro-batches, documents finished at the end of the input.

What a page shows by itself (regions, rows, columns, cells) is computed as pages arrive and appended to a table; what needs
the whole document (header filter, policy, ids) runs over that table, as batch plans, once the document is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..model import TEXT_ITEMS
from ..plans.convert import region_cells


def stream_items(spark: SparkSession, path: str) -> DataFrame:
    """Positioned text from Parquet files as they appear; a page must arrive within one file."""
    return spark.readStream.schema(TEXT_ITEMS).parquet(path)


def append_cells(items: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Cells of each micro-batch's pages, a folder for each batch: a batch that is run again replaces its own."""

    def batch(df: DataFrame, number: int) -> None:
        region_cells(df)[0].write.mode("overwrite").parquet(f"{target}/batch={number}")

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
