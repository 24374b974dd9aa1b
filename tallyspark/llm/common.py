"""What the text operators share: given tables, null rules, and texts as Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separator of words here.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


#: Rows in an Arrow batch, unless the session names a number of its own: texts are long, and a batch
#: is held on both sides of a worker.
BATCH_ROWS = 1000
_ROWS_SETTING, _ROWS_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def workers_ready(spark: SparkSession) -> None:
    """Bound Arrow batches, and let Python workers find this package where they share the driver's
    folders; elsewhere it is installed or added with addPyFile, as any package."""
    if spark.conf.get(_ROWS_SETTING) == _ROWS_DEFAULT:
        spark.conf.set(_ROWS_SETTING, str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def given(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    workers_ready(spark)
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "documents")


def whole_text(column: str | Column = "text") -> Column:
    """The text, null as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int | None = None):
    """(batch, texts) with null texts as empty strings, a bounded number of characters at a time."""
    for batch in batches:
        start, held = 0, 0
        texts = batch.column(batch.schema.get_field_index(column))
        lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(False)
        for i, n in enumerate(lengths):
            held += int(n)
            if held >= (limit or BATCH_BYTES) or i + 1 == len(lengths):
                part = batch.slice(start, i + 1 - start)
                yield part, [x or "" for x in texts.slice(start, i + 1 - start).to_pylist()]
                start, held = i + 1, 0


#: Bytes of text that a Python worker holds as strings at once, but for a longer single text.
BATCH_BYTES = 4 << 20


def only(batch: pa.RecordBatch, *names: str) -> dict[str, pa.Array]:
    return {n: batch.column(batch.schema.get_field_index(n)) for n in names}


#: Marks are one bit for each of 2**23 remainders of an id: 256 rows of 4 KB, whatever the input.
_MARK_BITS, _ROW_BITS = 23, 15


def _place(ids: str | Column) -> Column:
    return (F.col(ids) if isinstance(ids, str) else ids).bitwiseAND((1 << _MARK_BITS) - 1)


def marked(rows: DataFrame, ids: str | Column) -> DataFrame:
    """The marks of the given ids (longs), always all 256 rows."""
    found = rows.select(_place(ids).alias("_p")).groupBy(F.shiftright("_p", _ROW_BITS).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.col("_p").bitwiseAND((1 << _ROW_BITS) - 1)).alias("_bits")
    )
    all_ = rows.sparkSession.range(1 << (_MARK_BITS - _ROW_BITS)).withColumnRenamed("id", "_bucket")
    return all_.join(found, "_bucket", "left")


def _with_mark(rows: DataFrame, ids: str | Column, marks: DataFrame) -> DataFrame:
    spot = _place(ids).bitwiseAND((1 << _ROW_BITS) - 1)
    placed = rows.withColumn("_bucket", F.shiftright(_place(ids), _ROW_BITS)).withColumn("_spot", spot.cast("int"))
    joined = placed.join(F.broadcast(marks), "_bucket")  # at most 1 MB
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright("_spot", 3) + 1, F.lit(1))), 16, 10)
    mark = F.expr("shiftright(coalesce(_byte, 0), _spot & 7) & 1") == 1
    return joined.withColumn("_byte", byte.cast("int")).withColumn("_mark", mark).drop("_bucket", "_bits", "_spot", "_byte")


def possibly(rows: DataFrame, ids: str | Column, marks: DataFrame) -> DataFrame:
    """The rows whose id may be among the marked ones: all of those, and few others unless the marks
    are crowded. A narrow pass."""
    return _with_mark(rows, ids, marks).filter("_mark").drop("_mark")


def split_by_marks(rows: DataFrame, ids: str | Column, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose id is surely not marked, rows whose id may be)."""
    found = _with_mark(rows, ids, marks)
    return found.filter("NOT _mark").drop("_mark"), found.filter("_mark").drop("_mark")
