"""The folder every executor can reach, and tables written there to cut lineage.

A written table survives lost executors and is read back with column pruning and pushdown,
which a cached row block does not offer.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}

#: Of what is written; a quarter or so smaller than Spark's default.
CODEC = "zstd"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`. A local session without one gets a folder of
    its own; a cluster session without one is an error, since a machine-local folder would not
    be visible to all executors."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own_folders:
        _own_folders[sc.applicationId] = tempfile.mkdtemp(prefix="tallyspark-")
    return _own_folders[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/tallyspark-{app}/{name}-{uuid.uuid4().hex[:12]}"


def remove_written(spark: SparkSession) -> None:
    """Remove every table this application wrote to the shared folder. Frames read from them, and the
    marts of the application, can't be used afterwards."""
    folder = f"{shared_folder(spark)}/tallyspark-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def write_by(df: DataFrame, column: str, path: str, touched_only: bool = False, laid_out: bool = False) -> None:
    """Write a Parquet dataset partitioned by a column, replacing what is there, or with
    `touched_only` just the values that the frame has.

    `rebalance` gives each value whole files of the advisory size: small values share a task, a
    value too large for one task is split. Rows that are `laid_out` like that are not moved again."""
    rows = df if laid_out else df.hint("rebalance", column)
    out = rows.write.mode("overwrite").option("compression", CODEC).partitionBy(column)
    out.option("partitionOverwriteMode", "dynamic" if touched_only else "static").parquet(path)


def written(df: DataFrame, name: str, by: str | None = None, laid_out: bool = False) -> DataFrame:
    """Write a frame as Parquet in the shared folder, `by` a column if given, and read it back."""
    path = new_path(df.sparkSession, name)
    if by:
        write_by(df, by, path, laid_out=laid_out)
    else:
        df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_with(spark: SparkSession, written_at: dict[str, str]) -> None:
    """Put written tables in the place of others, {folder of the old one: folder of the new one}. Folders are
    renamed, nothing is written again."""
    for old, new in written_at.items():
        target, source = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (old, new))
        files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.delete(target, True)
        if not files.rename(source, target):
            raise OSError(f"{new} could not be moved to {old}")
    for old in written_at:
        spark.catalog.refreshByPath(old)


def allow_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder unless the caller chose one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    allow_checkpoints(df.sparkSession)
    return df.checkpoint()
