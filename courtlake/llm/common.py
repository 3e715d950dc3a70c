"""What several operators share: stored steps, words, and row numbers."""
from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlake.session import scratch_dir

_LOWER = {b: b + 32 for b in range(65, 91)}
_ALNUM = set(range(48, 58)) | set(range(97, 123)) | set(range(128, 256))
#: Lower-cases A-Z and turns every byte that no ASCII-alphanumeric word holds into a space.
ALNUM_TABLE = bytes(b if (b := _LOWER.get(x, x)) in _ALNUM else 32 for x in range(256))
LOWER_TABLE = bytes(_LOWER.get(x, x) for x in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased words of ASCII digits, a-z and everything beyond ASCII."""
    return text.encode().translate(ALNUM_TABLE).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Lower-cased words between ASCII white space (space, \\t, \\n, \\v, \\f, \\r)."""
    return text.encode().translate(LOWER_TABLE).split() if text else []


_stored: ContextVar[list[str] | None] = ContextVar("stored", default=None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: read again by later steps, and safe against lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    if (paths := _stored.get()) is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The folders of all tables that are ``stored`` inside."""
    paths: list[str] = []
    before = _stored.set(paths)
    try:
        yield paths
    finally:
        _stored.reset(before)


def drop_stored(spark: SparkSession, paths: list[str], needed: DataFrame) -> list[str]:
    """Remove stored tables that ``needed`` does not read; those that it reads are returned."""
    reads = "\n".join(needed.inputFiles()) if paths else ""
    kept = [p for p in paths if p.rsplit("/", 1)[-1] + "/" in reads]
    for path in paths:
        if path not in kept:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shards_for(rows: int, target: int) -> int:
    """How many groups of about ``target`` rows hold ``rows``: the group size stays, their number grows."""
    return max(1, math.ceil(rows / target))


def text_column(df: DataFrame, text_col: str):
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))
