"""Track tables, CSV tracks, sound chunks, the job store and the report sink."""
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import clamp01, num, parse_clock, unfence_json
from ..operators.intervals import clean_rallies
from ..session import stored_rows

STORE = ("jobs", "users", "schools", "memberships", "auth_sessions", "job_students")
CSV_SCHEMA = "Frame string, Visibility string, X string, Y string"


def read_rallies(raw: DataFrame, durations: DataFrame, min_s: float = 3.0) -> DataFrame:
    """SRC-3: model answers (job_id, response) to validated rallies."""
    doc = F.from_json(unfence_json("response"), "sport string, rallies array<struct<start:string,end:string,intensity:string,note:string>>")
    d = raw.select("job_id", F.posexplode(doc["rallies"]).alias("pos", "r")).select(
        "job_id", "pos", parse_clock("r.start").alias("start_s"), parse_clock("r.end").alias("end_s"), num("r.intensity", None).cast("long").alias("intensity"), "r.note")
    return clean_rallies(d.filter("start_s is not null and end_s is not null"), durations, min_s, tie=("pos",))


def read_shuttle_csv(spark: SparkSession, path: str, meta: DataFrame) -> DataFrame:
    """SRC-4: Frame, Visibility, X, Y in pixels to normalized points. The folder ``clip_id=..`` names the clip, or a fifth
    column does where a file holds the tracks of many clips; ``meta`` has clip_id, start_s, fps, width, height."""
    d = spark.read.option("header", True).option("mode", "PERMISSIVE").schema(CSV_SCHEMA + ", clip_id bigint").csv(path)
    n = {c: F.col(c).try_cast("double") for c in ("Frame", "Visibility", "X", "Y")}
    d = d.withColumns(n).filter((F.floor("Visibility") > 0) & (F.col("X") > 0) & (F.col("Y") > 0) & F.col("Frame").isNotNull()).join(meta, "clip_id")
    one = F.lit(1)
    return d.select("clip_id", (F.col("start_s") + F.floor("Frame") / F.greatest(F.col("fps"), F.lit(1.0))).alias("t"), clamp01(F.col("X") / F.greatest("width", one)).alias("x"),
                    clamp01(F.col("Y") / F.greatest("height", one)).alias("y"), F.lit(0.82).alias("confidence"), F.lit("tracknetv3").alias("source"))


def read_store(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """SRC-5."""
    return {t: spark.read.parquet(f"{root}/{t}") for t in STORE}


def save_tracks(df: DataFrame, path: str, buckets: int = 64, mode: str = "overwrite", key: str = "job_id", order: str = "t") -> None:
    """SRC-9: tracks partitioned by a hash of the job, sorted by time inside files, so a reader of some jobs opens
    few files and min/max statistics prune time ranges. Partitions by job itself would make a file per game.

    Rows are spread over (bucket, time slice), so one long game is not one writer task."""
    d = df.withColumn("job_bucket", F.pmod(F.hash(key), F.lit(buckets)))
    d = d.repartition("job_bucket", F.floor(F.col(order) / 3600)).sortWithinPartitions("job_bucket", key, order)
    d.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("job_bucket").parquet(path)


def load_tracks(spark: SparkSession, path: str, job_ids: list | None = None, buckets: int = 64, key: str = "job_id") -> DataFrame:
    """Read tracks back; ``job_ids`` prunes to their partitions."""
    d = spark.read.parquet(path)
    if job_ids is not None:
        lits = [F.lit(j).cast(d.schema[key].dataType) for j in job_ids]
        d = d.filter(F.col("job_bucket").isin(*[F.pmod(F.hash(x), F.lit(buckets)) for x in lits]) & F.col(key).isin(*lits))
    return d.drop("job_bucket")


def read_pcm_chunks(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: 16-bit sound chunks to samples in -1..1."""
    return spark.read.parquet(path).withColumn("samples", F.transform("samples", lambda s: s / F.lit(32768.0)))


def pcm_samples(chunks: DataFrame, chunk_len: int) -> DataFrame:
    """One row per sample, numbered from the chunk's place in the recording."""
    d = chunks.select("job_id", "chunk_no", F.posexplode("samples").alias("_k", "s"))
    return d.select("job_id", (F.col("chunk_no") * chunk_len + F.col("_k")).alias("i"), "s")


def write_reports(df: DataFrame, path: str, schema_tag: str, refresh: bool = False, buckets: int = 64, key: str = "job_id", compression: str = "none") -> DataFrame:
    """SRC-8: JSON reports. Jobs that already have a report under this tag are skipped unless ``refresh``; a stale
    tag is rebuilt. Returns the rows written. Partitions by hash bucket are overwritten whole, so
    the kept reports of a touched bucket are written again with the new ones."""
    spark = df.sparkSession
    new = df.withColumns({"schema_tag": F.lit(schema_tag), "job_bucket": F.pmod(F.hash(key), F.lit(buckets))})
    try:
        old = spark.read.schema(new.schema).json(path)
    except AnalysisException:                     # nothing written yet
        old = None
    if old is not None:
        fresh = old.filter(F.col("schema_tag") == schema_tag)
        todo = new if refresh else new.join(fresh.select(key), key, "left_anti")
        todo = stored_rows(todo, "todo")                                           # the read below must not see its own overwrite
        keep = fresh.join(todo.select("job_bucket").distinct(), "job_bucket", "left_semi")
        if refresh:                                                                # else what is kept and what is to do have no job in common
            keep = keep.join(todo.select(key), key, "left_anti")
        keep = stored_rows(keep.select(*new.columns), "kept")
        out = todo.unionByName(keep)
    else:
        todo = out = new
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression).partitionBy("job_bucket").json(path)
    return todo.drop("job_bucket")
