"""Tables that several later steps read, computed once.

``staged`` cuts the lineage of a table with ``checkpoint()``: it is written to the folder that the cluster names in
``spark.checkpoint.dir``, so reading it back needs no executor to have survived.  That is the same on every master; only
where the setting is absent and all runs in one process, as in tests, is a folder made.  Spark removes the files of tables that nobody refers to
any more if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, which all executors share; an error on a cluster that names none."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="roadtrace-checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def staged(df: DataFrame) -> DataFrame:
    """``df``, written now and read from the shared folder by all that use it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Written:
    """A table written now as compressed Parquet in the shared folder, until ``remove`` after its last reader.

    Unlike a checkpoint it is read by column and by partition.  Whatever is still to be computed from it must be written
    before it is removed.
    """

    def __init__(self, df: DataFrame, partition_by: list[str] | None = None):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = f"{shared_folder(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.partitionBy(*(partition_by or [])).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names)

    def remove(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
