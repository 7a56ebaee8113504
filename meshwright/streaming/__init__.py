"""Edge ingest from growing folders of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.sources.edges import parse_edge_lines


def stream_text_edges(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """(src, dst) of text edge files as they arrive, by the rules of batch ingest."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return parse_edge_lines(lines)


def running_degrees(edges: DataFrame) -> DataFrame:
    """(v, degree): out-degrees of the edges seen so far."""
    return edges.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("degree"))
