"""What several operators share: tables in the shared folder, and joins that a hot key can't overload."""

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the text contracts: space, and tab to carriage return.
SPACE = r"\x20\x09-\x0D"
#: A key with more than 1/HOT_PARTS of the rows (and over HOT_ROWS of them) is hot, and one with over MOST_ROWS of them, if that
#: makes at most MOST_KEYS hot keys.
HOT_PARTS = 1000
HOT_ROWS = 2000
MOST_ROWS = 1_000_000
MOST_KEYS = 100_000

ARROW_ROWS = 1000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors see.

    Where it is unset, a temporary folder serves if Spark runs in this one process; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear_tables() -> None:
    """Delete all tables that materialize() wrote; frames that read them are invalid from then on."""
    while _written:
        spark, path = _written.pop()
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; what is left lies in the shared folder
            return


atexit.register(clear_tables)


def tables_so_far() -> int:
    return len(_written)


def only(df: DataFrame, since: int) -> DataFrame:
    """df as a table, and no other of those that were written after the first `since`: what led to df is deleted."""
    out = materialize(df)
    last = _written.pop()
    while len(_written) > since:
        _remove(*_written.pop())
    _written.append(last)
    tidy(df.sparkSession)
    return out


def tidy(spark: SparkSession) -> None:
    """Collect garbage on the driver, so that executors drop the broadcasts and shuffles that nothing refers to any more, and
    then on the executors, by a small job: they give the freed heap back to the system.

    A long run of small jobs else fills their memory with those, and keeps it beside what Python workers need.
    """
    gc.collect()
    spark._jvm.System.gc()
    tasks = spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def compact(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """df dealt to no more partitions than its size needs (64 MB each), but as many as there are cores: fewer tiny files.

    For narrow rows: it shuffles them, while the joins and sorts before keep their own partitions.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, rows * row_bytes // (64 << 20) + 1))


def materialize(df: DataFrame, rows: int | None = None, row_bytes: int = 64) -> DataFrame:
    """Write df as a table in the shared folder and read it: cuts lineage, and outlives lost executors.

    rows: a bound of df's rows, if one is known; the table is then written compact.
    """
    spark = df.sparkSession
    if rows is not None:
        df = compact(df, rows, row_bytes)
    path = f"{shared_dir(spark)}/palimpsest-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_counted(left: DataFrame, right: DataFrame, on: list[str], rows: str, total: int) -> DataFrame:
    """Inner join of left with right, whose keys are unique and whose column `rows` counts the left rows of each key.

    Hot keys (at most MOST_KEYS rows, so the broadcast is bounded) are joined by broadcast; all others by Spark's own
    choice, each task then getting a small share of the rows.
    Both sides are read twice if there are such keys: pass tables, not long plans.
    """
    most = max(min(total // HOT_PARTS, MOST_ROWS), HOT_ROWS, total // MOST_KEYS)
    hot = F.col(rows) > most
    if total <= most or not right.filter(hot).limit(1).count():
        return left.join(right, on)
    few = F.broadcast(right.filter(hot))
    warm = left.join(few, on)
    cold = left.join(few.select(*on), on, "left_anti").join(right.filter(~hot), on)
    return warm.unionByName(cold)


def to_python(df: DataFrame) -> DataFrame:
    """df, about to go to Python with whole texts: the session's Arrow batches are cut to ARROW_ROWS rows, if they are larger.

    At the default of 10,000 rows, a batch of texts takes tens of megabytes, held twice, in each task.
    """
    conf = df.sparkSession.conf
    if int(conf.get(_ARROW_ROWS)) > ARROW_ROWS or int(conf.get(_ARROW_ROWS)) <= 0:
        conf.set(_ARROW_ROWS, str(ARROW_ROWS))
    return df


def release() -> None:
    """Give memory that a Python worker no longer uses back to the system: idle workers stay for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of df has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("string")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batch: pa.RecordBatch, text: str, size_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about so many bytes of text, so that what is made from them stays small."""
    lengths, start, size = pc.binary_length(batch.column(text)).to_pylist(), 0, 0
    for i, n in enumerate(lengths):
        size += n
        if size >= size_bytes:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
