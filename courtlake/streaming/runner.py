"""Drain a bounded stream to a table: for backfills and for checking an online operator against its batch form."""
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_dir
from .fold import STATE_CONF, STATE_STORE

SLICE_ROWS = 1_000_000


def feed(spark: SparkSession, df: DataFrame, root: str, parts: int | None = None, order: str = "t", sentinel: DataFrame | None = None,
         late: DataFrame | None = None) -> DataFrame:
    """Open ``df`` as a stream that takes one slice a batch, slices by ``order`` one after the other, so state is carried from
    batch to batch. There are as many slices as it takes for a million rows each, three at least; rows without an order come
    first. The table is dealt to slices in one pass, and each slice is read once more. A sentinel row
    far in the future lets watermarks close the last windows; ``late`` rows come after it."""
    path, dealt = f"{root}/in", f"{root}/dealt"
    at = F.col(order).cast("double")
    if parts is None:
        parts = max(3, math.ceil(df.count() / SLICE_ROWS))
    shares = F.array(*[F.lit(k / parts) for k in range(1, parts)]) if parts > 1 else None
    cuts = (df.agg(F.percentile_approx(at, shares, F.lit(1000 + 20 * parts)).alias("c")).first()["c"] or []) if parts > 1 else []
    inner = F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>")
    slice_ = F.coalesce(F.size(F.filter(inner, lambda c: c < at)), F.lit(0))
    df.withColumn("_slice", F.when(at.isNull(), 0).otherwise(slice_)).write.partitionBy("_slice").parquet(dealt)
    known = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_slice", T.IntegerType())])).parquet(dealt)
    for k in range(len(cuts) + 1):
        known.where(F.col("_slice") == k).select(*df.columns).coalesce(1).write.mode("append").parquet(path)
    for rows in (sentinel, late):
        if rows is not None:
            rows.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(stream: DataFrame, root: str, mode: str = "append", sink: Callable | None = None, watch: Callable | None = None) -> DataFrame:
    """Run a stream until its input is used up, into Parquet (or through a ``foreachBatch`` sink), and read the result.
    ``watch`` gets the finished query. The query takes the session's settings when it starts, so its state store is set for it alone."""
    out, spark = f"{root}/out", stream.sparkSession
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    was = spark.conf.get(STATE_CONF, None)
    spark.conf.set(STATE_CONF, STATE_STORE)
    try:
        q = w.format("parquet").option("path", out).start() if sink is None else w.foreachBatch(sink(out)).start()
    finally:
        if was is None:
            spark.conf.unset(STATE_CONF)
        else:
            spark.conf.set(STATE_CONF, was)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    if watch is not None:
        watch(q)
    return spark.read.schema(stream.schema).parquet(out)


def fresh_root(spark: SparkSession) -> str:
    return scratch_dir(spark, "stream")
