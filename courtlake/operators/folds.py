"""State machines over ordered groups, streamed row by row in bounded memory."""
from collections.abc import Callable, Iterator, Sequence
from itertools import chain, groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLUSH = 8192


def tiled_fold(df: DataFrame, keys: Sequence[str], idx: str, summarize: Callable, advance: Callable, walk: Callable, start: Callable,
               state: str, schema: str, cols: Sequence[str], size: int = 65536) -> DataFrame:
    """A fold whose steps compose: each tile of ``size`` rows is reduced to what it does to any incoming
    state (``summarize``), those few summaries are chained per group (``advance``), and the tiles are
    walked in parallel from their true starting state. A long group is spread over its tiles.

    ``idx`` is the 0-based row position; ``state`` the type of both the summary and the state, an
    array<double>; ``start(first_row)`` gives the state before a group's first row."""
    keys = list(keys)
    d = df.withColumn("_tile", F.floor(F.col(idx) / size))
    tile = [*keys, "_tile"]
    cols = list(cols)

    def reduce_tile(rows):
        rows = iter(rows)
        first = next(rows)
        yield (list(start(first)), list(summarize(chain([first], rows))))

    def chain_tiles(rows):
        s = None
        for t, begin, summary in rows:
            s = list(begin) if s is None else s
            yield t, s
            s = list(advance(s, summary))

    parts = ordered_fold(d, tile, [idx], reduce_tile, f"_begin {state}, _summary {state}", cols)
    starts = ordered_fold(parts, keys, ["_tile"], chain_tiles, f"_tile long, _state {state}", ["_tile", "_begin", "_summary"])

    def walk_tile(rows):
        s = None
        for *r, begin in rows:
            s = list(begin) if s is None else s
            s, out = walk(s, tuple(r))
            yield out

    return ordered_fold(d.join(starts, tile), tile, [idx], walk_tile, schema, [*cols, "_state"]).drop("_tile")


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence, fn: Callable[[Iterator[tuple]], Iterator[tuple]],
                 schema: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Run ``fn`` over each group's rows in order and return keys plus what it yields.

    Spark shuffles by ``keys`` and sorts inside the partitions, and the Arrow batches are walked
    once: a group is never held whole, in the JVM or in Python. Callers split long groups at points
    where the state provably restarts before they call this. ``fn`` gets tuples of ``cols``
    (default: all non-key columns, in order).
    """
    keys = list(keys)
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in keys]
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    # By a hash of the keys: a repartition by the keys themselves is dropped above a join by them, whose own layout goes when that
    # join becomes a broadcast while the query runs. Nothing tells Spark that the walk below needs it.
    ready = df.repartition(F.hash(*keys)).sortWithinPartitions(*[F.col(k) for k in keys], *order).select(*keys, *cols)
    n = len(keys)
    added = T._parse_datatype_string(schema)
    out = T.StructType([df.schema[k] for k in keys] + added.fields)
    names = out.fieldNames()

    def run(batches):
        import pandas as pd

        def rows():
            for b in batches:
                yield from zip(*[b[c].tolist() for c in b.columns])

        buf = []
        for key, group in groupby(rows(), key=lambda r: r[:n]):
            for res in fn(r[n:] for r in group):
                buf.append(key + res)
                if len(buf) >= _FLUSH:
                    yield pd.DataFrame(buf, columns=names)
                    buf = []
        if buf:
            yield pd.DataFrame(buf, columns=names)

    return ready.mapInPandas(run, out)


def ordered_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Mean of the doubles of each group, added up in ``order``; groups without a value are left out. A sum of doubles depends on the
    order of its terms, so that an average over partial sums depends on where the rows lie."""

    def mean(rows):
        total, n = 0.0, 0
        for (x,) in rows:
            total, n = total + x, n + 1
        yield (total / n,)

    return ordered_fold(df.filter(F.col(value).isNotNull()), keys, order, mean, f"{out} double", [value])
