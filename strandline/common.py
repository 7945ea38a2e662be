"""Small pieces that every plan shares: scratch tables, size-checked joins, first row of each id, usable vectors."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import weakref
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its counted rows times its row width stay below this many bytes.
BROADCAST_BYTES = 32 << 20

#: Paths of the tables that ``materialize`` wrote, and the folders they lie in.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_FOLDERS: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table as a lazy scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share, with a folder of this application in it.

    Without that setting a session on one machine (a local master) uses the machine's folder for temporary files; on a
    cluster it is an error, for tables written to the executors' own disks would be lost rows.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            named = known.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            named = f"{tempfile.gettempdir()}/spark-tables"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage like ``checkpoint()``, survives the loss of executors, is compressed, and gives Catalyst the real
    size of the data for later joins. ``discard`` deletes a table that nothing reads any more; what is left goes with
    the end of the Python process.
    """
    spark = df.sparkSession
    folder = scratch_dir(spark)
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(*_delete_call(spark, folder))
    path = f"{folder}/{uuid.uuid4().hex}"
    (df.repartition(*by) if by else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` gave; call it only when nothing that is still to run reads them."""
    for df in tables:
        if path := _WRITTEN.pop(df, None):
            delete, *args = _delete_call(df.sparkSession, path)
            delete(*args)


def _delete_call(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())

    def delete(files, where) -> None:
        with contextlib.suppress(Exception):  # the JVM may have ended before the process does
            files.delete(where, True)

    return delete, files, where


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan over all cores where it has fewer splits than the cluster has cores (one small file).

    ``df`` should be a scan with expressions and filters: counting the splits of a plan with a shuffle would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str, row_bytes: int) -> DataFrame:
    """Join where ``right`` is broadcast only if its counted size allows it; otherwise a shuffled join that AQE may split.

    ``right`` is counted, so it should be materialized before.
    """
    return left.join(F.broadcast(right) if right.count() * row_bytes <= BROADCAST_BYTES else right, on, how)


def first_rows(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row of each non-null ``key``: the first by ``order``, further ties by the hash of the whole row.

    Only the rows of repeated keys are shuffled with all their columns; the others stay where they were read. Rows
    whose key is null are left out.
    """
    repeated = materialize(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_")).where("n_ > 1").select(key))
    n = repeated.count()
    if n == 0:
        return df.where(F.col(key).isNotNull())
    side = F.broadcast(repeated) if n * 64 <= BROADCAST_BYTES else repeated
    once = df.where(F.col(key).isNotNull()).join(side, key, "left_anti")
    rank = Window.partitionBy(key).orderBy(*order, F.xxhash64(*[F.col(c) for c in df.columns]))
    many = df.join(side, key, "left_semi").withColumn("rank_", F.row_number().over(rank)).where("rank_ = 1").drop("rank_")
    return once.select(*df.columns).unionByName(many.select(*df.columns))


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with ``place`` (0-based, in its group) and the running sums ``sums`` up to and with each row.

    A group is never one task's work, however many rows it has: the rows are cut by range of group and order, placed and
    summed within each range, and each range takes over what lies before it in its group, of which there is one number
    for each range. ``order`` should be unique in a group; the rows should be narrow, for they are written once, and have
    no column of a name that is added.
    """
    sums = sums or {}
    ranged = rows.select("*", *(c.alias(f"{n}_") for n, c in sums.items())).repartitionByRange(*[F.col(c).asc_nulls_first() for c in [*by, *order]])
    ranged = materialize(ranged.withColumn("range_", F.spark_partition_id()))
    within = Window.partitionBy(*by, "range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*by, "range_").agg(F.count("*").alias("place"), *(F.sum(f"{n}_").alias(n) for n in sums))
    bases = totals.select(*[F.col(c).alias(f"{c}_of") for c in by], F.col("range_").alias("range_of"), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_base") for n in ("place", *sums)))
    placed = ranged.select("*", F.count("*").over(within).alias("place"), *(F.sum(f"{n}_").over(within).alias(n) for n in sums))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in by]
    joined = placed.join(bases, reduce(lambda a, b: a & b, same, F.col("range_") == F.col("range_of")))
    return joined.select(*rows.columns, (F.col("place") + F.col("place_base") - 1).alias("place"), *((F.col(n) + F.col(f"{n}_base")).alias(n) for n in sums))


def is_finite(c: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def usable_vector(c: Column, size: int) -> Column:
    """A vector of ``size`` finite numbers that are not all zero."""
    finite = ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(c) == size) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def host(url: Column) -> Column:
    """Host of a url in lower case, without user, port, path; null where there is none."""
    found = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", found)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
