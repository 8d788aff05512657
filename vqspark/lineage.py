"""Written results, running sums and numbers over whole tables without a single task for all rows."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that one task adds up in order.
FAN = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share for written tables: that of ``spark.checkpoint.dir``.

    Only a session on one machine (master ``local``) may go without; it gets a folder of its own.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="vqspark-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder; a lost executor costs no more than what came after."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files behind results that are written, once nothing refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, much smaller than a checkpoint, and its path, to be removed after use."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    """Removes a written table, in any store."""
    store, place = _place(spark, path)
    store.delete(place, True)


def stored(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at ``path``; it is made and written first where it isn't there yet or was left unfinished."""
    store, done = _place(spark, f"{path}/_SUCCESS")
    if not store.exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def running_total(rows: DataFrame, key: str, value: str, name: str = "total") -> DataFrame:
    """``rows`` with the sum of ``value`` up to each row, by the whole number ``key`` (0 and up, each once).

    Runs of keys are added up in tasks of their own, and so are the sums of runs, level by level.
    """
    if (rows.agg(F.max(key)).first()[0] or 0) < FAN:
        return rows.withColumn(name, F.sum(value).over(Window.partitionBy(F.lit(0)).orderBy(key)))
    run, sums, before = f"{key}_run", f"{value}_sum", f"{value}_before"
    own = rows.withColumn(run, F.floor(F.col(key) / FAN))
    runs = cut(own.groupBy(run).agg(F.sum(value).alias(sums)))
    until = running_total(runs, run, sums, "until").select(run, (F.col("until") - F.col(sums)).alias(before))
    within = F.sum(value).over(Window.partitionBy(run).orderBy(key))
    return own.join(until, run).withColumn(name, F.col(before) + within).drop(run, before)


def last_before(rows: DataFrame, run: str, order: str, values: list[str]) -> DataFrame:
    """``rows`` with ``<value>_before`` for each of ``values``: the last that isn't null in the rows before, by the whole numbers ``run`` and ``order``.

    Runs are gone through in tasks of their own, and so are the ends of runs, level by level.
    """

    def within(part, by: str) -> dict:
        before = Window.partitionBy(part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return {f"{v}_before": F.last(v, ignorenulls=True).over(before) for v in values}

    ends = cut(rows.groupBy(run).agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values)))
    few = ends.limit(FAN + 1).count() <= FAN
    if few:
        found = ends.withColumns(within(F.lit(0), run))
    else:
        found = last_before(ends.withColumn(f"{run}_run", F.floor(F.col(run) / FAN)), f"{run}_run", run, values)
    starts = found.select(run, *(F.col(f"{v}_before").alias(f"{v}_start") for v in values))
    own = rows.withColumns(within(run, order)).join(F.broadcast(starts) if few else starts, run)
    return own.withColumns({f"{v}_before": F.coalesce(f"{v}_before", f"{v}_start") for v in values}).drop(*(f"{v}_start" for v in values))
