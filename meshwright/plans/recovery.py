"""Cutting lineage so that lost executors cost little: checkpoints and written tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a temporary one is made and set in local mode (tests); on a cluster, whose machines would not share it, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        set_by_user = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_by_user.get() if set_by_user.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def own_dir(spark: SparkSession) -> str:
    """The application's own part of the shared folder, which holds its written tables."""
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes all written tables of this application. Results read them lazily: call it once they are stored elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and keeps it as a checkpoint, which survives lost executors.

    Planned without adaptive execution (the session's setting is put back): the loops' exchanges are combined and dealt
    evenly, planning anew after each costs more than the step, and a fixed plan tells how the checkpoint is dealt, so
    that the next step joins it without a shuffle.
    """
    shared_dir(df.sparkSession)
    conf, key = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    was = conf.get(key)
    conf.set(key, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        conf.set(key, was)


def written(df: DataFrame, name: str) -> DataFrame:
    """Computes ``df`` once into a Parquet table of the shared folder, so that later reads take only the columns they need; ``clear`` deletes it."""
    path = f"{own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
