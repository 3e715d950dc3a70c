"""Numbers, clocks, text and small predicates as Column expressions (no Python UDFs)."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c, default: float | None = 0.0) -> Column:
    """PRJ-1: parse or fall back."""
    return F.coalesce(col(c).try_cast("double"), F.lit(default))


def field(name):
    """Accessor for higher-order functions: one argument, so Spark does not pass an index."""
    return lambda x: x[name]


def clamp(c: Column, lo, hi) -> Column:
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    return F.greatest(lo, F.least(hi, c))


def clamp01(c, default: float = 0.0) -> Column:
    return clamp(num(c, default), 0.0, 1.0)


def parse_clock(c) -> Column:
    """FN-5: "75", "1:15" or "1:02:03" to seconds; null when a part is not a number."""
    parts = F.filter(F.split(F.trim(col(c)), ":"), lambda p: p != "")
    return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p.try_cast("double"))


def abs_time(t, start, dur, pad: float = 3.6) -> Column:
    """PRJ-5: a worker time that can only be rally-relative is moved onto the source clock."""
    t, start, dur = col(t), col(start), col(dur)
    return F.when((t < start - 0.25) & (t >= 0) & (t <= dur + pad), start + t).otherwise(t)


def short_text(c, limit: int) -> Column:
    """PRJ-13: collapse white space and shorten to ``limit`` characters before the ellipsis."""
    s = F.trim(F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), r"\s+", " "))
    cut = F.concat(F.rtrim(F.substring(s, 1, max(0, limit - 1))), F.lit("..."))
    return F.when(F.length(s) <= limit, s).otherwise(cut)


def redact(c) -> Column:
    """PRJ-14: first and last four characters of a secret."""
    s = col(c)
    return (F.when(s.isNull() | (s == ""), None).when(F.length(s) <= 8, s)
            .otherwise(F.concat(F.substring(s, 1, 4), F.lit("..."), F.right(s, F.lit(4)))))


def basename(c) -> Column:
    s = F.rtrim(col(c), F.lit("/"))
    return F.when(s == "", None).otherwise(F.substring_index(s, "/", -1))


def clean_texts(c, limit: int, chars: int) -> Column:
    """PRJ-15: shortened, non-empty, distinct in order, at most ``limit``."""
    shortened = F.transform(col(c), lambda x: short_text(x, chars))
    return F.slice(F.array_distinct(F.filter(shortened, lambda x: x != "")), 1, limit)


def clean_moments(c, max_rally, limit: int = 3) -> Column:
    """PRJ-16: moments that name an existing rally and carry a label and a reason."""
    mapped = F.transform(
        col(c),
        lambda m: F.struct(
            F.floor(num(m["rally_index"])).cast("int").alias("rally_index"),
            short_text(m["label"], 42).alias("label"),
            short_text(m["reason"], 90).alias("reason"),
        ),
    )
    ok = F.filter(mapped, lambda m: m["rally_index"].between(1, col(max_rally)) & (m["label"] != "") & (m["reason"] != ""))
    return F.slice(ok, 1, limit)


def unfence_json(c) -> Column:
    """FN-13: strip a Markdown code fence around a JSON answer."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(col(c)), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def fmt_duration(c) -> Column:
    """FN-14: whole seconds as "Xm Ys"."""
    s = F.greatest(F.lit(0), F.floor(col(c) + 0.5)).cast("long")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(
        F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))


def evidence_text(times, limit: int = 120, minimum: int = 10) -> Column:
    """FN-15: the first impact times as whole seconds; empty when the signal is thin."""
    a = F.sort_array(col(times))
    shown = F.array_join(F.transform(F.slice(a, 1, limit), lambda t: F.bround(t, 0).cast("long").cast("string")), ", ")
    return F.when(F.size(a) < minimum, "").otherwise(shown)


def to_db(rms, floor: float = -80.0) -> Column:
    """FN-16: RMS to dBFS with a silence floor."""
    return F.lit(20.0) * F.log10(F.greatest(col(rms), F.lit(10.0 ** (floor / 20.0))))


def upper_median(c) -> Column:
    """Element n//2 of the sorted values, for groups of bounded size only."""
    return F.get(F.sort_array(F.collect_list(col(c))), F.floor(F.count(col(c)) / 2).cast("int"))
