"""Cutting lineage through the folder that driver and executors share; bounded Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where spark.checkpoint.dir is unset and all runs on this machine, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp())
    return context.getCheckpointDir()


_made: list[str] = []


def _clean() -> None:
    """Removes the tables that this driver has written; where the file system can't be reached, they stay."""
    from gridloom.sources.store import _opened

    for path in _made:
        try:
            files, at = _opened(path if ":" in path.partition("/")[0] else f"file:{path}")
            files.delete_dir(at)
        except Exception:  # noqa: S112, the process is ending
            continue
    _made.clear()


atexit.register(_clean)


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


#: Bytes of one Arrow batch that goes to a Python worker, where the session sets no limit; a longer row makes its own batch.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """The same table, before an Arrow stage: without a limit in bytes Spark puts 10,000 rows, that is whole chunks, into one batch. Plans run when their rows are asked for, so the session keeps the setting."""
    if df.sparkSession.conf.get(_BATCH, None) is None:
        df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    return df


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Writes a table and reads it; columns that a later plan doesn't need aren't read again."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
