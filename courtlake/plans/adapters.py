"""The given tables read as tracking data.

Every adapter is a projection of one whole table with arithmetic both engines evaluate alike: ``e0`` literals
are doubles in Spark and in DuckDB. ``{us}`` is microseconds since 2024-01-01."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_US_SPARK = "(unix_micros(cast(ts as timestamp)) - 1704067200000000)"
_US_DUCK = "(epoch_us(ts) - 1704067200000000)"
_SEC = "cast(floor({us} / 1000000e0) as bigint)"

# name -> (table, columns)
ADAPTERS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    # shuttle points: one track per user, hours read as seconds
    "pts": ("events", [
        ("job_id", "user_id % 10"), ("track_id", "user_id"), ("pid", "event_id"), ("t", "{us} / 3600000000e0"),
        ("x", f"case when event_id % 37 = 0 then 0.97e0 else 1e-1 + 8e-1 * abs({_SEC} % 200000 - 100000) / 100000e0 end"),
        ("y", f"2e-1 + 6e-1 * abs({_SEC} % 140000 - 70000) / 70000e0"),
        ("confidence", "(event_id * 31 % 100) / 100e0"), ("visible", "event_type <> 'error'"), ("value", "value"), ("kind", "event_type")]),
    # the same points at 25 Hz or so: dense tracks for the smoothers and the camera
    "dense": ("events", [
        ("job_id", "user_id % 10"), ("rally_index", "user_id"), ("pid", "event_id"), ("t", "event_id / 1200e0"),
        ("x", "5e-1 + 38e-2 * (event_id * 7 % 101 - 50) / 50e0 * 1e-1 + 3e-1 * (event_id % 997) / 997e0 - 15e-2"),
        ("y", "36e-2 + 22e-2 * (event_id * 11 % 97 - 48) / 48e0 * 1e-1 + 2e-1 * (event_id % 911) / 911e0"),
        ("z", "1e0 + value / 2000e0"), ("confidence", "(event_id * 31 % 100) / 100e0"), ("frame_no", "event_id"), ("value", "value"), ("kind", "event_type")]),
    "rallies": ("orders", [
        ("job_id", "o_custkey"), ("rally_id", "o_orderkey"), ("start_s", "cast(o_orderkey * 7919 % 3600 as double)"),
        ("end_s", "o_orderkey * 7919 % 3600 + 3e0 + (o_orderkey * 13 % 270) / 10e0"), ("dur", "3e0 + (o_orderkey * 13 % 270) / 10e0"),
        ("intensity", "cast(substr(o_orderpriority, 1, 1) as bigint)"), ("note", "o_orderstatus"), ("price", "o_totalprice")]),
    "peaks": ("events", [
        ("job_id", "event_id * 7 % 1500"), ("peak_id", "event_id"), ("t", "event_id * 17 % 3600 + (event_id % 20) / 20e0"), ("prominence_db", "8e0 + value / 20e0")]),
    "boxes": ("lineitem", [
        ("job_id", "l_suppkey"), ("frame_no", "l_orderkey % 200"), ("track_id", "cast(l_linenumber as bigint)"), ("okey", "l_orderkey"), ("pkey", "l_partkey"),
        ("t", "(l_orderkey % 200) / 6e0"), ("x1", "(l_partkey % 80) / 100e0"), ("y1", "(l_partkey * 3 % 60) / 100e0"),
        ("x2", "(l_partkey % 80) / 100e0 + 5e-2 + l_linenumber / 100e0"), ("y2", "(l_partkey * 3 % 60) / 100e0 + 2e-1 + l_linenumber / 50e0"),
        ("confidence", "((l_orderkey * 7 + l_linenumber * 13) % 100) / 100e0"), ("qty", "l_quantity")]),
    "samples": ("lineitem", [
        ("job_id", "l_suppkey"), ("shot_id", "l_orderkey"), ("k", "cast(l_linenumber as bigint)"), ("pkey", "l_partkey"), ("t", "l_orderkey % 500 + l_linenumber / 12e0"),
        ("x", "(l_partkey % 61) / 10e0"), ("y", "l_linenumber * 21e-1 - 1e0 + (l_orderkey % 10) / 10e0"),
        ("z", "((l_partkey * 7 + l_linenumber) % 45) / 10e0 - 1e-1"), ("residual_px", "l_quantity")]),
    "jobs": ("orders", [
        ("id", "o_orderkey"), ("job_id", "o_orderkey"), ("uploaded_by", "o_custkey"), ("school_id", "o_custkey % 25"),
        ("status", "case o_orderstatus when 'F' then 'failed' when 'O' then 'queued' else 'done' end"),
        ("pipeline", "case when substr(o_orderpriority, 1, 1) in ('1', '2') then 'gpu' else 'cpu' end"),
        ("created_at", "{day} + o_orderkey % 7"), ("started_at", "{day} + o_orderkey % 90"), ("finished_at", "{day} + o_orderkey % 90 + o_orderkey * 31 % 2500 - 20"),
        ("priority", "o_orderpriority"), ("price", "o_totalprice")]),
    "members": ("customer", [
        ("user_id", "c_custkey"), ("name", "c_name"), ("school_id", "cast(c_nationkey as bigint)"),
        ("role", "case c_mktsegment when 'BUILDING' then 'admin' when 'MACHINERY' then 'coach' else 'student' end"), ("created_at", "c_custkey * 60"), ("bal", "c_acctbal")]),
    "schools": ("nation", [
        ("school_id", "cast(n_nationkey as bigint)"), ("name", "n_name"), ("student_code", "upper(substr(n_name, 1, 3)) || n_nationkey"),
        ("coach_code", "upper(substr(n_name, 1, 3)) || (n_nationkey * 7 % 25)")]),
    # one court per supplier: a quad around the frame's middle that differs job by job
    "courts": ("supplier", [
        ("job_id", "s_suppkey"), ("ax", "30e-2 + (s_suppkey % 7) / 100e0"), ("ay", "30e-2 - (s_suppkey % 5) / 100e0"), ("bx", "70e-2 - (s_suppkey % 5) / 100e0"), ("by_", "31e-2"),
        ("cx", "90e-2"), ("cy", "90e-2 - (s_suppkey % 3) / 100e0"), ("dx", "10e-2 + (s_suppkey % 4) / 100e0"), ("dy", "88e-2"), ("bal", "s_acctbal")]),
    "texts": ("conversations", [("conv_id", "conv_id"), ("turn", "turn"), ("role", "role"), ("text", "text"), ("n_chars", "cast(length(text) as bigint)")]),
}
_DAY = {"spark": "(unix_micros(cast(o_orderdate as timestamp)) div 1000000)", "duck": "(epoch_us(o_orderdate) // 1000000)"}


def _render(expr: str, engine: str) -> str:
    return expr.replace("{us}", _US_SPARK if engine == "spark" else _US_DUCK).replace("{day}", _DAY[engine])


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def load(spark: SparkSession, sf: str, name: str, rows: DataFrame | None = None, only: tuple[str, ...] = ()) -> DataFrame:
    """The adapter over its table, or over those ``rows`` of it; all its columns, or ``only`` some."""
    source, cols = ADAPTERS[name]
    return (table(spark, sf, source) if rows is None else rows).selectExpr(*[f"{_render(e, 'spark')} as {n}" for n, e in cols if not only or n in only])


def ctes(*names: str) -> str:
    """DuckDB WITH clause for the adapters, without the closing query."""
    parts = []
    for name in names:
        source, cols = ADAPTERS[name]
        parts.append(f"{name} AS (SELECT " + ", ".join(f"{_render(e, 'duck')} AS {n}" for n, e in cols) + f" FROM {source})")
    return "WITH " + ",\n".join(parts)


def court_quads(spark: SparkSession, sf: str) -> DataFrame:
    pts = [F.array("ax", "ay"), F.array("bx", "by_"), F.array("cx", "cy"), F.array("dx", "dy")]
    return load(spark, sf, "courts").withColumn("corners", F.array(*pts))


def game_durations(spark: SparkSession, sf: str, seconds: float = 3600.0) -> DataFrame:
    return load(spark, sf, "rallies").select("job_id").distinct().withColumn("duration", F.lit(seconds))
