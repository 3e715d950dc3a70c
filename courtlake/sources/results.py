"""Result documents and labelled clips read into flat tables."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def explode_results(docs: DataFrame) -> dict[str, DataFrame]:
    """Nested documents to tables; all stay lazy, so a reader of one table never decodes the others."""
    r = docs.select("job_id", F.posexplode("rallies").alias("rally_index", "r")).select("job_id", "rally_index", "r.*")
    v = r.select("job_id", "rally_index", "vision.*")
    shots = r.filter(F.col("rally_3d.status") == "ok").select("job_id", "rally_index", F.posexplode("rally_3d.shots").alias("shot_id", "s")).select("job_id", "rally_index", "shot_id", "s.*")
    boxes = v.select("job_id", "rally_index", F.posexplode("players").alias("frame_no", "f")).select("job_id", "rally_index", "frame_no", "f.t", F.posexplode("f.boxes").alias("box_no", "b"))
    people = v.select("job_id", "rally_index", F.posexplode("poses").alias("frame_no", "f")).select("job_id", "rally_index", "frame_no", "f.t", F.inline("f.people"))
    return {
        "jobs": docs.select("job_id", "sport", F.coalesce("source.duration", "duration").alias("duration"), "source.w", "source.h", F.col("audio.status").alias("audio_status")),
        "all_rallies": docs.select("job_id", F.posexplode("all_rallies").alias("rally_id", "r")).select(
            "job_id", "rally_id", F.col("r.start").alias("start_s"), F.col("r.end").alias("end_s"), "r.dur", "r.intensity", "r.note", "r.used"),
        "rallies": r.drop("vision", "rally_3d").withColumnsRenamed({"start": "start_s", "end": "end_s"}),
        "rally_quality": v.drop("shuttle", "players", "poses"),
        "shuttle_points": v.select("job_id", "rally_index", F.posexplode("shuttle").alias("pid", "p")).select("job_id", "rally_index", "pid", "p.*"),
        "player_boxes": boxes.select("job_id", "rally_index", "frame_no", "t", "box_no", "b.*"),
        "poses": people,
        "courts": docs.select("job_id", "court.*"),
        "audio_peaks": docs.select("job_id", F.inline("audio.peaks")),
        "audio_energy": docs.select("job_id", F.explode("audio.series").alias("s")).select("job_id", F.col("s")[0].alias("t"), F.col("s")[1].alias("db")),
        "shots": shots.drop("samples"),
        "shot_samples": shots.select("job_id", "rally_index", "shot_id", F.posexplode("samples").alias("k", "p")).select("job_id", "rally_index", "shot_id", "k", "p.*"),
        "rejections": r.select("job_id", "rally_index", F.explode("rally_3d.rejected").alias("gate", "n")),
        "camera_path": r.select("job_id", "rally_index", F.posexplode("camera_path").alias("k", "p")).select("job_id", "rally_index", "k", "p.*"),
    }


def read_results(spark: SparkSession, path: str, multi_line: bool = False) -> dict[str, DataFrame]:
    """SRC-1: result documents (one per line, or one per file with ``multi_line``). A document without a
    job_id takes its folder's name."""
    docs = spark.read.schema(schemas.RESULT).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return explode_results(docs.withColumn("job_id", F.coalesce("job_id", folder)))


def explode_labels(labels: DataFrame) -> dict[str, DataFrame]:
    """Label sections are optional: a missing one gives no rows."""
    r = labels.select("clip", F.coalesce("fps", F.lit(30.0)).alias("fps"), F.inline("rallies")).withColumnRenamed("rally", "rally_index")
    key = ["clip", "rally_index"]
    frames = r.select(*key, F.explode("players").alias("f")).select(*key, "f.t", F.inline("f.boxes"))
    pose = r.select(*key, F.explode("pose").alias("f")).select(*key, "f.t", F.inline("f.people")).select(*key, "t", "id", "bbox.*", "keypoints")
    return {
        "rallies": r.select(*key, "fps"),
        "shuttle": r.select(*key, F.posexplode("shuttle").alias("id", "p")).select(*key, "id", "p.*"),
        "players": frames, "pose": pose,
        "shots3d": r.select(*key, F.posexplode("shots3d").alias("label_id", "s")).select(
            *key, "label_id", F.col("s.t_hit").alias("t"), F.col("s.speed_kmh").alias("speed"), F.get("s.landing_xy_m", F.lit(0)).alias("land_x"), F.get("s.landing_xy_m", F.lit(1)).alias("land_y")),
    }


def read_bench(spark: SparkSession, manifest: str, results: str, labels: str) -> dict[str, dict[str, DataFrame]]:
    """SRC-7: clips of a manifest with their results and labels. Documents are joined on the manifest's names, so
    unlisted files do not count. The clip's name becomes the key on both sides."""
    m = spark.read.schema(schemas.MANIFEST).json(manifest).withColumn("name", F.coalesce("name", "labels"))
    docs = spark.read.schema(schemas.RESULT).json(results)
    docs = docs.join(m.select("name", F.col("result").alias("job_id")), "job_id").withColumn("job_id", F.col("name")).drop("name")
    labs = spark.read.schema(schemas.LABELS).json(labels)
    labs = labs.join(m.select("name", F.col("labels").alias("clip")), "clip").withColumn("clip", F.col("name")).drop("name")
    return {"results": explode_results(docs), "labels": explode_labels(labs)}
