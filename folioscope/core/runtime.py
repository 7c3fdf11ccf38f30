"""Session defaults, table access, durable cuts of lineage and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and bytes of its texts and lists, up to which a side may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 128 << 20


def local_session(cores: int | str = "*", memory: str = "12g", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folioscope")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One of the parquet tables, narrowed to the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, on one machine where it is unset (tests), a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not context.master.startswith("local["):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="folioscope-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows are written to the shared folder and read from there, so that lost executors cost nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As `durable`, as a compressed table of which a reader takes only the columns it needs; for wide or large rows.

    `durable` keeps the partitioning of its rows, this doesn't.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{_own(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _own(spark: SparkSession) -> str:
    return f"tables-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Removes the tables that `written` left in the shared folder for this application, once their results are no longer read.

    The files of `durable` go with their DataFrame if the cluster sets `spark.cleaner.referenceTracking.cleanCheckpoints`.
    """
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{_own(spark)}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_checked(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `most` rows of at most `BROADCAST_BYTES` in all, else as it is, to be joined by shuffle.

    `df` is computed once more for the check, so it should be a small table, an aggregate of one, or durable.
    """
    some = df.limit(most + 1)
    wide = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))]
    if not wide:
        return F.broadcast(df) if some.count() <= most else df
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in wide])))), F.lit(0))
    rows, size = some.agg(F.count("*"), size).first()
    return F.broadcast(df) if rows <= most and size <= BROADCAST_BYTES else df


def spread(df: DataFrame) -> DataFrame:
    """A scan for costly work on each row: over all cores, where the files alone make fewer tasks than there are cores.

    Larger inputs come in more splits than cores and stay as they are. Only for scans: a plan with a shuffle would run for the count.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def current(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per `key`: of several deliveries the one with the greatest `order`; of rows that tie in it, any one.

    Only (`key`, `order`) is shuffled. The keys that were delivered more than once go back to the rows, so that wide rows stay where
    they were read; only rows that tie go through a shuffle of their own.
    """
    per = df.groupBy(key, order).agg(F.count("*").alias("_n"))
    top = per.groupBy(key).agg(F.max(F.struct(F.col(order), "_n")).alias("_m"), F.sum("_n").alias("_t")).filter("_t > 1")
    top = durable(top.select(F.col(key).alias("_key"), F.col(f"_m.{order}").alias("_top"), F.col("_m._n").alias("_n")))
    met = df.join(broadcast_checked(top), F.col(key).eqNullSafe(F.col("_key")), "left").filter(F.col("_n").isNull() | F.col(order).eqNullSafe(F.col("_top")))
    if top.filter("_n > 1").limit(1).count():
        tied = met.filter("_n > 1").dropDuplicates([key])
        met = met.filter("_n IS NULL OR _n = 1").unionByName(tied)
    return met.drop("_key", "_top", "_n")
