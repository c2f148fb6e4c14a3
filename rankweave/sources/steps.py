"""Tables of finished steps in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir. Where that is unset, a local one in local mode (tests), else an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="rankweave-")
    return f"{named.rstrip('/')}/rankweave-{uuid.uuid4().hex}"


class Steps:
    """Cuts lineage by written tables, which survive the loss of any executor; all are removed at the end of a with block."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.count = spark, shared_folder(spark), 0

    def __enter__(self) -> Steps:
        return self

    def __exit__(self, *_: object) -> None:
        self._delete(self.folder)

    def _delete(self, path: str) -> None:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def kept(self, rows: DataFrame, replaced: DataFrame | None = None) -> DataFrame:
        """rows, written and read back; the table `replaced`, which kept() made and rows were made from, goes."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        rows.write.parquet(path)
        made = self.spark.read.schema(rows.schema).parquet(path)
        made._step = path
        if replaced is not None:
            self._delete(replaced._step)
        return made
