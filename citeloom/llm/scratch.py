"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import ship

_written: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode one of our own where it is unset."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="citeloom-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses; removed when the process ends."""
    path = f"{shared_dir(spark)}/citeloom-{uuid.uuid4().hex}-{name}"
    _written.append((spark, path))
    return path


def few(spark: SparkSession) -> int:
    """Files of a table that is narrow and small beside its input: a sixteenth of the shuffle's partitions, and two for each core of the cluster at least."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(parts, max(2 * spark.sparkContext.defaultParallelism, parts // 16)))


#: Bytes of a source's files for one task of what is made of it.
FILE_BYTES = 128 << 20


def sized(df: DataFrame, source: DataFrame) -> DataFrame:
    """df in as many tasks as its source, a table of files, has spans of FILE_BYTES, and at least two for each core; fewer stay as they are."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(min(1 << 30, max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // FILE_BYTES))))


def materialize(df: DataFrame, name: str, files: str = "as is") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, so that lost executors cost no recomputation.

    files: "as is"; "fewer" for a narrow table whose last stage is light (its tasks do more each); "gathered"
    for one whose last stage is heavy (a small shuffle follows it). Each file costs its creation, the setting
    of its rights and a read later, whatever its size.
    """
    spark = df.sparkSession
    if files != "as is":
        df = df.coalesce(few(spark)) if files == "fewer" else df.repartition(few(spark))
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._citeloom_path = path
    return out


def make_dir(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)


def discard(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(df: DataFrame) -> None:
    """Remove a materialized table that nothing reads any more."""
    discard(df.sparkSession, df._citeloom_path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                discard(spark, path)
        except Exception:
            return


#: Keys of which each has over a HEAVY-th of the rows: there are fewer than HEAVY of them, whatever the data.
HEAVY = 1000


def counted(right: DataFrame, n: str = "n") -> tuple[int, int]:
    """Rows of a table and the sum of its column n."""
    rows, total = right.agg(F.count(F.lit(1)), F.coalesce(F.sum(n), F.lit(0))).first()
    return rows, total


def join_counted(left: DataFrame, right: DataFrame, key: str, n: str = "n", how: str = "inner", size: tuple[int, int] | None = None) -> DataFrame:
    """left joined with right, which has a row for each key and in column n how many rows of left have it.

    Keys with over a HEAVY-th of all rows are fewer than HEAVY, so they are broadcast and their rows of left
    are dealt out by their content; the others are shuffled by key. So no key makes a task of its own, and
    what is broadcast has a bound. right is read more than once: a written table. Column n goes. size: what
    counted() gives for right, where it is known.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how is inner or left, not {how!r}")
    rows, total = size or counted(right, n)
    values = [c for c in right.columns if c not in (key, n)]
    if rows <= HEAVY:
        return left.join(F.broadcast(right.drop(n)), key, how)
    told = right.select(F.col(key).alias("_k"), F.struct(F.lit(True).alias("_"), *values).alias("_v"), (F.col(n) * HEAVY > F.lit(total)).alias("_heavy"))
    heavy = told.where("_heavy").select(F.col("_k").alias("_hk"), F.col("_v").alias("_hv"))
    light = told.where("not _heavy").select(F.col("_k").alias("_lk"), F.lit(0).alias("_ls"), F.col("_v").alias("_lv"))
    x = left.join(F.broadcast(heavy), F.col(key) == F.col("_hk"), "left")
    deal = F.pmod(F.xxhash64(*left.columns) + F.spark_partition_id(), F.lit(1 << 20)).cast("int") + 1
    x = x.withColumn("_s", F.when(F.col("_hk").isNotNull() | F.col(key).isNull(), deal).otherwise(0))
    x = x.join(light, (F.col(key) == F.col("_lk")) & (F.col("_s") == F.col("_ls")), "left")
    got = F.coalesce("_hv", "_lv")
    x = x.select(F.col(key), *[F.col(c) for c in left.columns if c != key], *[got[c].alias(c) for c in values], got.isNotNull().alias("_found"))
    return (x.where("_found") if how == "inner" else x).drop("_found")


def running(rows: DataFrame, value: str, *order, name: str) -> DataFrame:
    """rows with the sum of a column over all rows before, in order, and none of it in one task: sorted by ranges, summed by range, then within."""
    r = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges", "fewer")
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = r.groupBy("_range").agg(F.sum(value).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    own = F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return r.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.coalesce(own, F.lit(0))).drop("_range", "_before")


#: Most rows and bytes of a batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Make a session ready for Python workers: they find the package, and they hold a few MB at once, however long the texts are.

    The session's batch limits are lowered where they are higher, for good: plans read them when they run.
    """
    ship(spark)
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name, None)
        if now is None or not now.isdecimal() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def give_back() -> None:
    """Return to the system what this process has freed: workers are used again by other tasks, and what they keep is missing from their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of a task's batches that gives back, when it has ended, what it held."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole
