"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest Arrow batch sent to a Python worker: rows and bytes.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20

#: Tables that written() made, by id of their DataFrame, which is held so that ids stay unique.
_written: dict[int, tuple[SparkSession, str, DataFrame]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small by bytes, so that long texts cannot fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local one in local mode (tests), else an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="rankweave-checkpoint-")
        sc.setCheckpointDir(named)
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut lineage: write df as Parquet to the shared folder and read it back. Survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rankweave-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    _written[id(made)] = (spark, path, made)
    return made


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps now: it does so when the driver collects their plans as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Remove tables that written() made and no later step reads."""
    for made in tables:
        spark, path, _ = _written.pop(id(made))
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may have ended
            pass


def delete_written() -> None:
    """Remove all tables that written() made in this process and that are still there."""
    discard(*[made for _, _, made in list(_written.values())])


atexit.register(delete_written)


def unused(df: DataFrame, name: str) -> str:
    """The name, made longer until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings; null becomes empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(id_col: Column, text: Column) -> Column:
    """A key of a row by its id and text, 16 bytes: rows that share it are equal for every operator here. A null differs from every value, in either place."""
    named, whole = id_col.cast("string"), text.cast("string")
    # two chains of different seeds, each with the nulls as values of their own
    halves = [F.xxhash64(F.lit(salt), named.isNull(), named, whole.isNull(), whole) for salt in (1, 2)]
    return F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in halves]))


def key_array(column: pa.Array) -> np.ndarray:
    """Row keys as numpy elements of 16 bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), "V16")


def key_column(keys: np.ndarray) -> pa.Array:
    """The Arrow column of row keys that are numpy elements of 16 bytes."""
    return pa.Array.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())


#: Byte table: A-Z lowered, bytes of word characters (0-9, a-z, 0x80 up) kept, all others a space.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def plain_words(text: str) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of text with A-Z lowered, as UTF-8.

    Every byte of a non-ASCII character is 0x80 or more, so cutting bytes equals cutting characters.
    """
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


def worker_state(name: str, make):
    """An object that is made once in a Python worker and kept for its later tasks (its value must not depend on the task)."""
    import sys
    import types

    held = sys.modules.setdefault("_rankweave_worker_state", types.ModuleType("_rankweave_worker_state"))
    if not hasattr(held, name):
        setattr(held, name, make())
    return getattr(held, name)
