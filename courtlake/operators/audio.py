"""Energy series and impact peaks."""
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import to_db
from .folds import ordered_fold
from .tiles import as_list, quantiles, sessionize, tile_scan, top_n, with_totals


def rms_series(pcm: DataFrame, sr: int = 16000, win: float = 0.10, hop: float = 0.05, floor: float = -80.0, key: str = "job_id") -> DataFrame:
    """AGG-19: windowed energy in dBFS. ``pcm`` holds one sample per row (job_id, i, s) with s in -1..1.

    A window ends ``win`` % ``hop`` samples into a hop, so samples reduce to two sums of squares per hop (map-side), before
    and behind that place, and windows are sums of these."""
    per_hop, per_win = max(1, int(hop * sr)), max(1, int(win * sr))
    width, rest = divmod(per_win, per_hop)
    late = (F.col("i") % per_hop >= rest).cast("int")
    parts = pcm.groupBy(key, F.floor(F.col("i") / per_hop).alias("h"), late.alias("_late")).agg(F.sum(F.col("s") * F.col("s")).alias("_sq"), F.count("*").alias("_n"))
    # a part belongs to the windows that start at its hop and at the hops before it from which they still reach it
    wins = parts.withColumn("_w0", F.greatest(F.lit(0), F.col("h") - width + F.col("_late"))).filter("_w0 <= h").select(key, F.explode(F.sequence("_w0", "h")).alias("w"), "_sq", "_n")
    wins = wins.groupBy(key, "w").agg(F.sum("_sq").alias("_sq"), F.sum("_n").alias("_n"))
    full = (F.col("_n") == per_win) | (F.col("w") == 0)
    return wins.filter(full).select(key, ((F.col("w") * per_hop + per_win / 2) / sr).alias("t"), to_db(F.sqrt(F.col("_sq") / F.col("_n")), floor).alias("db"))


def max_pool(series: DataFrame, n: int = 5, key: str = "job_id", tie: Sequence[str] = ()) -> DataFrame:
    """AGG-20: loudest of every ``n`` values, at the middle value's time."""
    from .tiles import row_index

    d = row_index(series, [key], "t", tie=tie, out="_i").withColumn("_g", F.floor(F.col("_i") / n))
    d = with_totals(d, [key, "_g"], _len=F.count("*"))
    mid = F.max(F.when(F.col("_i") - F.col("_g") * n == F.floor(F.col("_len") / 2), F.col("t")))
    return d.groupBy(key, "_g").agg(mid.alias("t"), F.max("db").alias("db")).drop("_g")


def find_peaks(series: DataFrame, min_prominence: float = 8.0, min_gap: float = 0.6, top: int | None = None, key: str = "job_id",
               tie: Sequence[str] = ()) -> DataFrame:
    """WIN-12: local maxima well above the median, strongest first, none closer than ``min_gap`` to a
    stronger one. Candidates ``min_gap`` apart cannot suppress each other, so runs of close candidates
    are settled in parallel; a ``top`` limit, if asked for, comes after."""
    d = tile_scan(series, [key], "t", tie=tie, prev={"_p": F.col("db")}, nxt={"_n": F.col("db")})
    d = d.join(quantiles(series, [key], "db", {"_floor": 0.5}), key)
    cand = d.filter((F.col("db") >= F.col("_p")) & (F.col("db") > F.col("_n")) & (F.col("db") - F.col("_floor") >= min_prominence))
    cand = cand.select(key, "t", "db", (F.col("db") - F.col("_floor")).alias("prominence_db"))
    cand = tile_scan(cand, [key], "t", tie=["db"], break_on=["t"], breaks=lambda c, p: c("t") - p("t") >= min_gap, seg="_run")

    def settle(rows):
        from bisect import bisect_left, insort

        taken = []
        for t, db, prom in rows:
            i = bisect_left(taken, t)
            if any(abs(t - u) < min_gap for u in taken[max(0, i - 1):i + 1]):
                continue
            insort(taken, t)
            yield t, db, prom

    picked = ordered_fold(cand, [key, "_run"], [F.desc("prominence_db"), F.desc("t"), F.desc("db")], settle,
                          "t double, db double, prominence_db double", ["t", "db", "prominence_db"])
    return top_n(picked.drop("_run"), [key], [F.desc("prominence_db"), F.desc("t"), F.desc("db")], top, out="_rn").drop("_rn")


def strongest(df: DataFrame, keys: Sequence[str], by: str, n: int, tie: Sequence[str] = (), desc: bool = True) -> DataFrame:
    """SRT-8."""
    return top_n(df, as_list(keys), [F.desc(by) if desc else F.asc(by), *[F.asc(c) for c in tie]], n)
