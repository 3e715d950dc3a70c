"""Worker payloads with many spellings, read into canonical tables.

Payloads are parsed once into VARIANT; every alias list is a ``coalesce`` of typed path lookups, so malformed
values become null and are skipped."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp01

MANY = "array<variant>"


def pick(v: Column, *paths: str, as_: str = "double") -> Column:
    found = [F.try_variant_get(v, f"$.{p}" if not p.startswith("[") else f"${p}", as_) for p in paths]
    return F.coalesce(*found)


def items(v: Column, *names: str) -> Column:
    """First non-empty list under the given names."""
    lists = [F.try_variant_get(v, f"$.{n}", MANY) for n in names]
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])


def people_of(v: Column, *names: str) -> Column:
    """``items``, but a bare list of keypoints is one person."""
    def people(name: str) -> Column:
        found, first = F.try_variant_get(v, f"$.{name}", MANY), f"$.{name}[0]"
        bare = F.try_variant_get(v, f"{first}.x", "variant").isNotNull() & F.try_variant_get(v, f"{first}.y", "variant").isNotNull()
        return F.when(F.size(found) > 0, F.when(bare, F.array(F.try_variant_get(v, f"$.{name}", "variant"))).otherwise(found))

    return F.coalesce(*map(people, names))


def match_by_index(rallies: DataFrame, payload: DataFrame, index_col: str = "raw_index", key: str = "job_id") -> DataFrame:
    """JOIN-1: a payload row naming the rally's index, else the one at its position. ``rallies`` is numbered from
    1; ``payload`` carries pos from 0."""
    named = payload.filter(F.col(index_col).isNotNull()).groupBy(key, F.col(index_col).alias("rally_index")).agg(F.min_by("rr", "pos").alias("_named"))
    placed = payload.select(key, (F.col("pos") + 1).alias("rally_index"), F.col("rr").alias("_placed"))
    d = rallies.join(named, [key, "rally_index"], "left").join(placed, [key, "rally_index"], "left")
    return d.withColumn("rr", F.coalesce("_named", "_placed")).drop("_named", "_placed")


def point(v: Column) -> Column:
    """{point: ..}, {x, y, confidence} or [x, y, confidence]; null without coordinates."""
    inner = F.coalesce(pick(v, "point", as_="variant"), v)
    known = F.coalesce(pick(inner, "x", as_="string"), pick(inner, "[0]", as_="string")).isNotNull() & F.coalesce(pick(inner, "y", as_="string"), pick(inner, "[1]", as_="string")).isNotNull()
    conf = F.coalesce(pick(v, "confidence", "conf"), pick(inner, "confidence", "conf", "score", "[2]"), F.lit(1.0))
    return F.when(known, F.struct(clamp01(pick(inner, "x", "[0]")).alias("x"), clamp01(pick(inner, "y", "[1]")).alias("y"), clamp01(conf, 1.0).alias("confidence"),
                                  pick(inner, "source", as_="string").alias("source")))


def box(v: Column) -> Column:
    """{box: ..}, corners, centre-free x/y/w/h, or a list; null otherwise."""
    inner = F.coalesce(pick(v, "box", as_="variant"), v)

    def all_there(*names: str) -> Column:
        c = pick(inner, names[0], as_="string").isNotNull()
        for n in names[1:]:
            c = c & pick(inner, n, as_="string").isNotNull()
        return c

    conf = clamp01(F.coalesce(pick(v, "confidence", "conf"), pick(inner, "confidence", "conf", "score", "[4]"), F.lit(1.0)), 1.0)
    tid = F.floor(pick(v, "track_id")).cast("long")

    def corners(names) -> Column:
        x1, y1, x2, y2 = (clamp01(pick(inner, n)) for n in names)
        return F.struct(F.least(x1, x2).alias("x1"), F.least(y1, y2).alias("y1"), F.greatest(x1, x2).alias("x2"), F.greatest(y1, y2).alias("y2"),
                        conf.alias("confidence"), tid.alias("track_id"))

    x, y, w, h = (clamp01(pick(inner, n)) for n in "xywh")
    sized = F.struct(x.alias("x1"), y.alias("y1"), F.least(F.lit(1.0), x + w).alias("x2"), F.least(F.lit(1.0), y + h).alias("y2"), conf.alias("confidence"), tid.alias("track_id"))
    return (F.when(all_there("x1", "y1", "x2", "y2"), corners(("x1", "y1", "x2", "y2"))).when(all_there("x", "y", "w", "h"), sized)
            .when(all_there("[0]", "[1]", "[2]", "[3]"), corners(("[0]", "[1]", "[2]", "[3]"))))


def _strong(boxes: Column, min_conf: float, cap: int | None) -> Column:
    """Boxes of enough confidence; with a ``cap`` the strongest of them, equal ones in the payload's order."""
    kept = F.filter(F.transform(boxes, lambda v, i: F.struct((-box(v)["confidence"]).alias("c"), i.alias("i"), box(v).alias("b"))), lambda s: s["b"].isNotNull() & (s["b"]["confidence"] >= min_conf))
    return F.transform(kept if cap is None else F.slice(F.array_sort(kept), 1, cap), lambda s: s["b"])


def _abs_t(v: Column) -> Column:
    t = F.coalesce(pick(v, "t", "time", "sec"), F.lit(0.0))
    start, dur = F.col("start_s"), F.col("dur")
    return F.when((t < start - 0.25) & (t >= 0) & (t <= dur + 3.6), start + t).otherwise(t)


def canonicalize_detections(raw: DataFrame, rallies: DataFrame, min_box_conf: float = 0.05, max_boxes: int | None = None,
                            max_people: int | None = None, max_racquets: int | None = None) -> dict[str, DataFrame]:
    """SRC-2: raw (job_id, payload) and rallies (job_id, rally_index from 1, start_s, dur) to shuttle points, player
    boxes, people and racquet boxes."""
    doc = raw.select("job_id", F.try_parse_json("payload").alias("v"))
    parts = doc.select("job_id", F.posexplode(items(F.col("v"), "rallies", "results", "clips")).alias("pos", "rr"))
    parts = parts.withColumn("raw_index", F.floor(pick(F.col("rr"), "rally_index", "index")).cast("long"))
    m = match_by_index(rallies, parts).filter(F.col("rr").isNotNull())
    key = ["job_id", "rally_index"]
    keep = [*key, "start_s", "dur"]
    rr, f = F.col("rr"), F.col("f")
    frames = m.select(*keep, F.posexplode(items(rr, "frames", "timeline")).alias("frame_no", "f")).withColumn("t", _abs_t(f))

    flat_xy = F.when(pick(f, "shuttle_x", as_="string").isNotNull() & pick(f, "shuttle_y", as_="string").isNotNull(), F.struct(
        clamp01(pick(f, "shuttle_x")).alias("x"), clamp01(pick(f, "shuttle_y")).alias("y"), clamp01(pick(f, "shuttle_confidence", "shuttle_conf"), 1.0).alias("confidence"),
        F.lit(None).cast("string").alias("source")))
    nested = pick(f, "shuttle", as_="variant")
    in_frames = frames.select(*key, "t", F.when(nested.isNotNull(), point(nested)).otherwise(flat_xy).alias("p"))
    tracks = m.select(*keep, F.explode(items(rr, "shuttle", "shuttle_track")).alias("s")).select(*key, _abs_t(F.col("s")).alias("t"), point(F.col("s")).alias("p"))
    shuttle = in_frames.unionByName(tracks).filter("p is not null").select(*key, "t", "p.*")

    framed = frames.select(*key, "frame_no", "t", f, _strong(items(f, "players", "player_boxes", "person_boxes", "people"), min_box_conf, max_boxes).alias("b"))
    tracked = m.select(*keep, F.posexplode(items(rr, "players", "player_tracks")).alias("frame_no", "f")).select(
        *key, "frame_no", _abs_t(f).alias("t"), _strong(items(f, "boxes", "players", "detections"), min_box_conf, max_boxes).alias("b"))
    players = framed.drop("f").unionByName(tracked).select(*key, "frame_no", "t", F.posexplode("b").alias("box_no", "x")).select(*key, "frame_no", "t", "box_no", "x.*")

    raw_people = people_of(f, "poses", "pose_tracks", "keypoints")
    people = framed.select(*key, "frame_no", "t", "b", F.posexplode(raw_people if max_people is None else F.slice(raw_people, 1, max_people)).alias("person_no", "p"))
    pts = F.filter(F.transform(F.coalesce(items(F.col("p"), "keypoints"), F.try_variant_get("p", "$", MANY)), point), lambda q: q.isNotNull())
    people = people.withColumn("keypoints", pts).filter(F.size("keypoints") > 0)
    mean = F.aggregate("keypoints", F.lit(0.0), lambda a, k: a + k["confidence"]) / F.size("keypoints")
    people = people.select(*key, "frame_no", "t", "person_no", F.floor(pick(F.col("p"), "track_id")).cast("long").alias("track_id"),
                           clamp01(F.coalesce(pick(F.col("p"), "confidence", "conf", "score"), mean)).alias("confidence"), "keypoints", F.get("b", F.col("person_no")).alias("bbox"))

    def racquets(kind: str, *names: str) -> DataFrame:
        r = frames.select(*key, "frame_no", "t", F.posexplode(_strong(items(f, *names), min_box_conf, max_racquets)).alias("box_no", "x"))
        return r.select(*key, "frame_no", "t", F.lit(kind).alias("kind"), "box_no", "x.*")

    return {"shuttle_points": shuttle, "player_boxes": players, "people": people,
            "racquet_boxes": racquets("measured", "racquets", "rackets", "racquet_boxes").union(racquets("candidate", "racquet_candidates", "racket_candidates"))}
