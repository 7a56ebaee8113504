"""How many parts a job is dealt into, from the input alone."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of stored input for each part of the packed exchanges; with it a part's arrays stay at some tens of MB.
PART_BYTES = 16 << 20


#: Rows to an Arrow batch of texts or pages: some MB, with which the buffers on both sides of the exchange stay small.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches have at most BATCH_ROWS rows; a smaller setting stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def parts(df: DataFrame, least: int = 12, per: int = PART_BYTES) -> int:
    """In proportion to the input: its scan tasks times what one may read, over ``per`` bytes."""
    tasks = df.rdd.getNumPartitions()
    most = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return max(least, -(-tasks * max(1, most) // max(1, per)) if most > per else tasks)
