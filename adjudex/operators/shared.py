"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, a temporary one in local mode; on a cluster an error, as executors share no disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="adjudex-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str = "core", by: tuple[str, ...] = ()) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: the lineage ends here and a lost executor costs no more than a re-read.

    With `by`, rows go to folders by these columns, of few values, so that a filter on them reads its own only. The table goes when the process ends, or with `discard`.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/adjudex-{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    atexit.register(_remove, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back.adjudex_path = path
    return back


def discard(*tables: DataFrame | None) -> None:
    """Removes tables that `saved` has returned and that nothing reads any more."""
    for df in tables:
        if df is not None:
            _remove(df.sparkSession, df.adjudex_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended before us
        pass


#: Rows that one task may sort at once where only one row per group of a corpus remains.
ONE_TASK = 1 << 20


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, or the same with underscores before it, so that it clashes with no column of `df`."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted = f"_{wanted}"
    return wanted


#: Bins into which the rows of a group are dealt by order: so many times so many.
BINS_SIDE = 32


def bin_bounds(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """`by` and bounds `name` that part each group's rows into BINS_SIDE^2 bins of like numbers, however values are spread: `fine` all, `coarse` every BINS_SIDE-th.

    They come from a quantile sketch, which tasks make of their rows and merge, to a tenth of a bin.
    """
    bins = BINS_SIDE * BINS_SIDE
    fine = rows.groupBy(*by).agg(F.percentile_approx(value, [i / bins for i in range(1, bins)], 10 * bins).alias(name))
    coarse = F.filter(name, lambda b, i: i % BINS_SIDE == BINS_SIDE - 1)
    return fine.withColumn(name, F.struct(coarse.alias("coarse"), F.col(name).alias("fine")))


def bin_of(value: Column, bounds: Column) -> Column:
    """How many of `bounds` a value reaches: found among the coarse ones, then among those after it. Null bounds or value: 0."""
    reached = lambda some: F.coalesce(F.greatest(F.size(F.filter(some, lambda b: b <= value)), F.lit(0)), F.lit(0))
    coarse = reached(bounds["coarse"]) * BINS_SIDE
    return (coarse + reached(F.slice(bounds["fine"], coarse + 1, F.lit(BINS_SIDE - 1)))).cast("int")


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], spread: bool = True) -> DataFrame:
    """`df` with a column for each of `sums`: its sum over the rows before, in `order`; 0 for the first.

    Rows are dealt to tasks by ranges of `order`; each task sums its own, and one small table has what all ranges before sum to. Rows
    alike in `order` lie in one range. Without `spread` one task does it all, which is for tables of a bounded number of rows.
    """
    before = lambda w: w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    if not spread:
        return df.withColumns({k: zero(F.sum(v).over(before(Window.partitionBy(F.lit(0))))) for k, v in sums.items()})
    part = free_name(df, "part")
    ranged = saved(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranged")
    offset = {k: free_name(df, f"{k}_offset") for k in sums}
    parts = ranged.groupBy(part).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    inside = Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(part, *[zero(F.sum(k).over(inside)).alias(offset[k]) for k in sums])
    own = before(Window.partitionBy(part))
    out = ranged.join(F.broadcast(parts), part).withColumns({k: zero(F.sum(v).over(own)) + F.col(offset[k]) for k, v in sums.items()})
    return out.drop(part, *offset.values())
