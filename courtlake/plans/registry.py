"""Named queries with their reference SQL.

``cols`` fixes the result columns once for both engines, as ``name:type`` with i (bigint), d (double, rounded
to 6 places so that summation order cannot show), s (string) and b (boolean)."""
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
IDS: dict[str, str] = {}

_SPARK = {"i": "bigint", "s": "string", "b": "boolean"}
_DUCK = {"i": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN"}


def _spec(cols: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in cols.split()]


def shape(df: DataFrame, cols: str) -> DataFrame:
    return df.select(*[
        (F.round(F.col(n).cast("double"), 6) + F.lit(0.0) if k == "d" else F.col(n).cast(_SPARK[k])).alias(n) for n, k in _spec(cols)])


def shape_sql(body: str, cols: str) -> str:
    out = ", ".join(f"round(CAST({n} AS DOUBLE), 6) + 0.0::DOUBLE AS {n}" if k == "d" else f"CAST({n} AS {_DUCK[k]}) AS {n}" for n, k in _spec(cols))
    with_, sep, final = body.rpartition("\nSELECT")
    if body.lstrip().upper().startswith("WITH") and sep:
        return f"{with_},\n_final AS (SELECT{final})\nSELECT {out} FROM _final"
    return f"SELECT {out} FROM ({body}) _final"


def query(name: str, ids: str, cols: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` for the survey ids it covers."""

    def register(fn):
        QUERIES[name] = lambda spark, sf: shape(fn(spark, sf), cols)
        IDS[name] = ids
        if sql is not None:
            ORACLES[name] = shape_sql(sql.strip(), cols)
        return fn

    return register
