"""What the operators share about sessions, tables and lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import trim

#: Rows and bytes of one Arrow batch, so that a Python worker's memory is bounded whatever the texts' lengths.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to the bounds above; never raises it."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    if size is not None and (not size.isdigit() or int(size) > BATCH_BYTES):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of its own in a local session that names none."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        return context.getCheckpointDir()
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


class _Written(threading.local):
    """Folders written by ``stored`` in this thread, in order, and not deleted since."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_WRITTEN = _Written()


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there and a lost executor costs nothing computed before."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Deletes what ``stored`` wrote from its ``since``-th folder on, but for the last ``keep``. Nothing may read these tables any more."""
    paths = _WRITTEN.paths
    for path in paths[since : len(paths) - keep]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    paths[since : len(paths) - keep] = []


def written() -> int:
    """How many folders there are, to be named to ``discard`` later."""
    return len(_WRITTEN.paths)


def repeated(df: DataFrame, times: str, number: str | None = None, run: int = 4096) -> DataFrame:
    """Each row as often as its ``times`` says, numbered from 0 in ``number``; in runs, so that no row holds an array of all its copies."""
    block, place = spare(df, "run"), number or spare(df, "number")
    out = df.where(F.col(times) > 0).withColumn(block, F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / run).cast("int"))))
    end = F.least(F.col(times).cast("int") - 1, F.col(block) * run + (run - 1))
    out = out.withColumn(place, F.explode(F.sequence(F.col(block) * run, end))).drop(times, block)
    return out if number else out.drop(place)


def fold(key: str, modulus: int):
    """crc32 of a key as text, modulo ``modulus``; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % modulus


def spare(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def extended(df: DataFrame, compute, ddl: str) -> DataFrame:
    """``df`` with the columns of ``ddl``, made from each Arrow batch by ``compute``; columns of these names are replaced."""
    import pyarrow as pa

    bounded_batches(df.sparkSession)
    new = schema(ddl)
    taken = {f.name.lower() for f in new}
    kept = [c for c in df.columns if c.lower() not in taken]
    out = T.StructType([*(df.schema[c] for c in kept), *new])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                columns = [*(batch.column(batch.schema.get_field_index(c)) for c in kept), *compute(batch)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new.names])
                del columns
                trim()

    return df.mapInArrow(run, out)
