"""What the operators share: reading tables, shared scratch tables, bounded samples of labelled rows.

No operator changes a setting of the caller's session. Spark bounds an Arrow batch by bytes
(spark.sql.execution.arrow.maxBytesPerBatch, 64 MB), so long texts fit a worker's memory.
"""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows that a Python worker turns into objects at a time.
SLICE_ROWS = 1000
_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; a null doc_id is never held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows, `rows` at a time."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def let_go() -> None:
    """Drops the encoders (and their memos) that tokenising stages have left in a Python worker which is used again."""
    tokens = sys.modules.get("inkloom.llm.tokens")
    if tokens:
        tokens.encoder.cache_clear()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet (case doesn't matter): `name`, with as many underscores as it takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder will do only if everything runs in one process (tests); on a cluster executors
    couldn't see it, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            found = held.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            found = tempfile.mkdtemp(prefix="inkloom-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is None:
        return
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session has ended already
        return


@atexit.register
def _drop_all() -> None:
    for path in list(_written):
        _delete(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted by release(), at the latest when the driver's Python ends."""
    path = f"{shared_dir(spark)}/inkloom-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and outlives any executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._inkloom_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of written() whose consumers have been written themselves."""
    for t in tables:
        _delete(getattr(t, "_inkloom_path", ""))


def unit_hash(*columns: str | Column) -> Column:
    """A hash of the columns as a number from 0 to 1."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, most_chars: int) -> DataFrame:
    """_id, _t, _y: text and label of about `most` labelled documents that aren't held out, whatever their label.

    A document is taken by a hash of its doc_id, so the choice depends neither on partitions nor on labels, and the share
    of label 1 is that of all rows, however many there are; up to `most` labelled documents all are taken. Labels of one
    doc_id that differ count as 1; of rows that share a doc_id the least text is taken. Texts over `most_chars` are left
    out of training (never of scoring): this and `most` bound what a model is fitted on. Null labels, doc_ids and texts
    are left out.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where(
        F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out("_id")
    )
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    n = known.count()
    chosen = known if n <= most else known.where(unit_hash("_id") < most / n)
    text = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_t")).where(F.col("_t").isNotNull() & (F.length("_t") <= most_chars))
    # about `most` rows of two integers
    joined = text.join(F.broadcast(chosen), "_id")
    return joined.groupBy("_id").agg(F.min("_t").alias("_t"), F.max("_y").alias("_y"))
