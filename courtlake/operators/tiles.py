"""Ordered computations over groups of any size.

A plain ``Window.partitionBy(keys)`` puts one game into one task. Here every group is cut into time
tiles first: rows are windowed inside (keys, tile), one summary row per tile is scanned over the
group, and the summary's carry is joined back. A game that holds a third of all rows spreads over as
many tasks as it has tiles. Results equal the plain window exactly.

The rows are shuffled once, by (keys, tile). Windows and summaries both read that one exchange, so the input is
read and computed once, however many scans follow: see :func:`lay_out`.

Keys and the order column must not be null.
"""
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TILE_CONF, TILE_S = "courtlake.tile.seconds", 10.0


def as_list(x) -> list:
    return [x] if isinstance(x, str) else list(x)


def time_tile(t: str, width: float | None = None) -> Column:
    """Tiles of ``width`` seconds; by default of the session's ``courtlake.tile.seconds`` (10: some 300 rows of a
    30 Hz track). Denser data wants a smaller value, see :func:`tile_seconds`."""
    if width is None:
        width = float(SparkSession.active().conf.get(TILE_CONF, str(TILE_S)))
    return F.floor(F.col(t) / F.lit(float(width)))


def tile_seconds(df: DataFrame, keys: Sequence[str], t: str, rows: int = 1_000_000) -> float:
    """Tile width that gives the densest key about ``rows`` rows a tile: one narrow, map-side combined pass."""
    per = df.groupBy(*as_list(keys)).agg(F.count("*").alias("n"), (F.max(t) - F.min(t)).alias("span"))
    w = per.agg(F.min(F.when(F.col("n") > rows, F.col("span") * rows / F.col("n"))).alias("w")).first()["w"]
    return TILE_S if w is None or w <= 0 else float(w)


def value_tile(v: str, per_octave: int = 1024) -> Column:
    """Monotone tiles for values of any scale: equal steps in log2 |v|, so that tiny values spread like large ones."""
    c = F.col(v).cast("double")
    steps = F.floor((F.log2(F.abs(c)) + F.lit(1100.0)) * F.lit(float(per_octave)))      # the least double lies at -1074
    return F.when(c > 0, steps).when(c < 0, -steps).otherwise(F.lit(0).cast("long"))


TILE = "_tile"


PART_ROWS = 100_000       # about so many narrow rows to a task, where they are widened there


def shared(df: DataFrame, by: Sequence[str], rows: int | None = None) -> DataFrame:
    """``df`` shuffled by ``by`` (rows with a null there go), for an operator that reads it several times: it is read and computed once.

    Spark computes an exchange once for all that read it, if they read the same columns. The rows travel as
    one packed column, so that whatever else than ``by`` a reader uses, the exchange is the same; what nobody needs should be left out before. A filter that one reader
    has on its own moves below its exchange, which then is not the others' any more. With the number of ``rows`` there are as many partitions as hold
    ``PART_ROWS`` each: by their bytes, of narrow rows that are widened later too many would meet in a task."""
    by = as_list(by)
    d = df
    for c in by:
        d = d if c == TILE else d.filter(F.col(c).isNotNull())
    rest = [c for c in df.columns if c not in by]
    parts = [] if rows is None else [max(2, -(-rows // PART_ROWS))]
    if not rest:
        return d.repartition(*parts, *by)
    d = d.select(*by, F.array(F.struct(*rest)).alias("_packed")).repartition(*parts, *by)
    return d.select(*[c if c in by else F.element_at("_packed", 1)[c].alias(c) for c in df.columns])


def rows_of(c: str) -> Column:
    """``count(*)`` that reads the packed column ``c``, so that a mere count shares the exchange too."""
    return F.count_if(F.coalesce(F.col(c) == F.col(c), F.lit(True)))


def lay_out(df: DataFrame, keys: Sequence[str], t: str, tile: Column | None = None) -> DataFrame:
    """``df`` shared by (keys, tile), with the tile as a further column. Scans over the result keep that layout and its one exchange."""
    # a tile that cannot be null lets no join add a filter to one reader alone, which would part it from the others' exchange
    at = F.coalesce(time_tile(t) if tile is None else tile, F.lit(0).cast("long"))
    return shared(df.filter(F.col(t).isNotNull()).withColumn(TILE, at), [*as_list(keys), TILE])


def tile_scan(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    *,
    tie: Sequence[str] = (),
    prev: Mapping[str, Column] | None = None,
    nxt: Mapping[str, Column] | None = None,
    csum: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    cmax: Mapping[str, Column] | None = None,
    ffill: Mapping[str, Column] | None = None,
    bfill: Mapping[str, Column] | None = None,
    breaks: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
    break_on: Sequence[str] = (),
    seg: str = "seg",
    tile: Column | None = None,
    whole: bool = False,
) -> DataFrame:
    """Add ordered columns to ``df``, in order of (t, *tie) within ``keys``.

    prev / nxt   value on the neighbouring row
    csum         running sum, this row included
    total        sum over the whole group
    cmax         running maximum of the rows before this one
    ffill/bfill  last / next non-null value, this row included
    breaks       ``breaks(cur, prev)`` says whether a row starts a new segment; ``seg`` counts them
                 from 0. ``break_on`` lists the columns it reads.

    A ``df`` from :func:`lay_out` (same keys) is scanned as it lies and keeps its tile column for the next scan. With ``whole`` each group is
    scanned in one piece, without tiles: for groups that fit into a task, and without a shuffle where they lie together (:func:`by_size`).
    """
    keys, tie, break_on = as_list(keys), as_list(tie), as_list(break_on)
    prev, nxt, csum, cmax, total = prev or {}, nxt or {}, csum or {}, cmax or {}, total or {}
    ffill, bfill = ffill or {}, bfill or {}
    if whole:
        return _whole_scan(df, keys, t, tie, prev, nxt, csum, total, cmax, ffill, bfill, breaks, break_on, seg)
    before = df.columns
    d = df if TILE in before else lay_out(df, keys, t, tile)
    order = [F.col(t), *map(F.col, tie)]
    rank = F.struct(*order)
    w = Window.partitionBy(*keys, "_tile").orderBy(*order)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    # looking ahead runs over the reversed order: a frame that ends at UNBOUNDED FOLLOWING costs Spark a pass per row
    ahead = Window.partitionBy(*keys, "_tile").orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    past = w.rowsBetween(Window.unboundedPreceding, -1)

    d = d.withColumns({
        **{f"_v_{o}": c for m in (prev, nxt, csum, total, cmax, ffill, bfill) for o, c in m.items()},
        **({"_b": F.struct(*break_on)} if breaks else {}),
    })
    local = {f"_l_{o}": F.lag(F.struct(f"_v_{o}")).over(w) for o in prev}
    local |= {f"_l_{o}": F.lead(F.struct(f"_v_{o}")).over(w) for o in nxt}
    local |= {f"_l_{o}": F.sum(f"_v_{o}").over(back) for o in csum}
    local |= {f"_l_{o}": F.max(f"_v_{o}").over(past) for o in cmax}
    local |= {f"_l_{o}": F.last(f"_v_{o}", True).over(back) for o in ffill}
    local |= {f"_l_{o}": F.last(f"_v_{o}", True).over(ahead) for o in bfill}
    summed = d
    if breaks:
        flagged = d.withColumn("_bp", F.lag("_b").over(w)).withColumn(
            "_flag",
            F.when(F.col("_bp").isNull(), 0).otherwise(
                F.coalesce(breaks(_field("_b"), _field("_bp")).cast("int"), F.lit(0))),
        )
        summed = flagged
        d = flagged
        local["_l_seg"] = F.sum("_flag").over(back)

    agg = {f"_s_{o}": F.max_by(F.struct(f"_v_{o}"), rank) for o in prev}
    agg |= {f"_s_{o}": F.min_by(F.struct(f"_v_{o}"), rank) for o in nxt}
    agg |= {f"_s_{o}": F.sum(f"_v_{o}") for o in [*csum, *total]}
    agg |= {f"_s_{o}": F.max(f"_v_{o}") for o in cmax}
    agg |= {f"_s_{o}": F.max_by(f"_v_{o}", F.when(F.col(f"_v_{o}").isNotNull(), rank)) for o in ffill}
    agg |= {f"_s_{o}": F.min_by(f"_v_{o}", F.when(F.col(f"_v_{o}").isNotNull(), rank)) for o in bfill}
    if breaks:
        agg |= {"_bf": F.min_by("_b", rank), "_bl": F.max_by("_b", rank), "_bn": F.sum("_flag")}
    s = summed.groupBy(*keys, "_tile").agg(*[c.alias(n) for n, c in agg.items()])

    ws = Window.partitionBy(*keys).orderBy("_tile")
    s_past = ws.rowsBetween(Window.unboundedPreceding, -1)
    s_next = Window.partitionBy(*keys).orderBy(F.desc("_tile")).rowsBetween(Window.unboundedPreceding, -1)
    carry = {f"_c_{o}": F.lag(f"_s_{o}").over(ws) for o in prev}
    carry |= {f"_c_{o}": F.lead(f"_s_{o}").over(ws) for o in nxt}
    carry |= {f"_c_{o}": F.sum(f"_s_{o}").over(s_past) for o in csum}
    carry |= {f"_c_{o}": F.sum(f"_s_{o}").over(Window.partitionBy(*keys)) for o in total}
    carry |= {f"_c_{o}": F.max(f"_s_{o}").over(s_past) for o in cmax}
    carry |= {f"_c_{o}": F.last(f"_s_{o}", True).over(s_past) for o in ffill}
    carry |= {f"_c_{o}": F.last(f"_s_{o}", True).over(s_next) for o in bfill}
    if breaks:
        s = s.withColumn("_bc", F.lag("_bl").over(ws)).withColumn(
            "_first",
            F.when(F.col("_bc").isNull(), 0).otherwise(
                F.coalesce(breaks(_field("_bf"), _field("_bc")).cast("int"), F.lit(0))),
        )
        carry["_c_seg"] = F.coalesce(F.sum(F.col("_bn") + F.col("_first")).over(s_past), F.lit(0)) + F.col("_first")
    s = s.select(*keys, "_tile", *[c.alias(n) for n, c in carry.items()])

    d = d.withColumns(local).join(s, [*keys, "_tile"])
    out = {o: F.coalesce(f"_l_{o}", f"_c_{o}")[f"_v_{o}"] for m in (prev, nxt) for o in m}
    out |= {o: F.coalesce(f"_l_{o}", F.lit(0)) + F.coalesce(f"_c_{o}", F.lit(0)) for o in csum}
    out |= {o: F.col(f"_c_{o}") for o in total}
    out |= {o: F.greatest(f"_l_{o}", f"_c_{o}") for o in cmax}
    out |= {o: F.coalesce(f"_l_{o}", f"_c_{o}") for m in (ffill, bfill) for o in m}
    if breaks:
        out[seg] = (F.col("_l_seg") + F.col("_c_seg")).cast("long")
    keep = [c for c in before if c not in out]
    return d.select(*keep, *[c.alias(n) for n, c in out.items()])


def _whole_scan(df, keys, t, tie, prev, nxt, csum, total, cmax, ffill, bfill, breaks, break_on, seg) -> DataFrame:
    order = [F.col(t), *map(F.col, tie)]
    w = Window.partitionBy(*keys).orderBy(*order)
    back, past = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    d = df
    for c in [*keys, t]:
        d = d.filter(F.col(c).isNotNull())
    out = {o: F.lag(F.struct(c.alias("v"))).over(w)["v"] for o, c in prev.items()}
    out |= {o: F.lead(F.struct(c.alias("v"))).over(w)["v"] for o, c in nxt.items()}
    out |= {o: F.coalesce(F.sum(c).over(back), F.lit(0)) for o, c in csum.items()}
    out |= {o: F.sum(c).over(Window.partitionBy(*keys)) for o, c in total.items()}
    out |= {o: F.max(c).over(past) for o, c in cmax.items()}
    out |= {o: F.last(c, True).over(back) for o, c in ffill.items()}
    out |= {o: F.last(c, True).over(ahead) for o, c in bfill.items()}
    cols = {c: F.col(c) for c in df.columns if c not in out and not (breaks and c == seg)}
    d = d.select(*[c.alias(n) for n, c in (cols | out).items()], *([F.struct(*break_on).alias("_b"), F.lag(F.struct(*break_on)).over(w).alias("_bp")] if breaks else []),
                 *[F.col(c).alias(f"_k_{i}") for i, c in enumerate([t, *tie])])
    if not breaks:
        return d.select(*cols, *out)
    flag = F.when(F.col("_bp").isNull(), 0).otherwise(F.coalesce(breaks(_field("_b"), _field("_bp")).cast("int"), F.lit(0)))
    counted = Window.partitionBy(*keys).orderBy(*[F.col(f"_k_{i}") for i in range(len(order))]).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("_flag", flag).withColumn(seg, F.sum("_flag").over(counted).cast("long")).select(*cols, *out, seg)


def _field(struct: str) -> Callable[[str], Column]:
    return lambda name: F.col(struct)[name]


def sessionize(df: DataFrame, keys: Sequence[str], t: str, gap: float, *, tie: Sequence[str] = (), seg: str = "seg",
               tile: Column | None = None) -> DataFrame:
    """WIN-3: a step longer than ``gap`` starts a new segment."""
    return tile_scan(df, keys, t, tie=tie, break_on=[t], breaks=lambda c, p: c(t) - p(t) > F.lit(float(gap)), seg=seg,
                     tile=tile)


def row_index(df: DataFrame, keys: Sequence[str], t: str, *, tie: Sequence[str] = (), out: str = "idx",
              tile: Column | None = None) -> DataFrame:
    """0-based position of each row within its group. Like every scan it takes rows that are laid out already as they lie."""
    return tile_scan(df, keys, t, tie=tie, csum={out: F.lit(1)}, tile=tile).withColumn(out, F.col(out) - 1)


def with_totals(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Join group aggregates back onto the rows. The aggregate is combined map-side first and the
    join is left to AQE, which broadcasts a small result and splits a skewed key."""
    keys = as_list(keys)
    return df.join(df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]), keys)


GROUP_ROWS = 131_072      # of a group that one task may hold


def by_size(df: DataFrame, keys: Sequence[str], most: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """``df`` as the groups of up to ``most`` rows, which lie together after one exchange of the rows as they are, and those of larger
    groups as they lie, none if there are none. For rows that are widened later: what is made of a small group then needs no
    further exchange. At most one in ``most`` rows is a large group, so their keys fit on the driver. Rows with a null key go."""
    keys = as_list(keys)
    counts = df.filter(F.expr(" and ".join(f"`{k}` is not null" for k in keys))).groupBy(*keys).agg(F.count("*").alias("_n"))
    is_large = F.col("_n") > most
    rows, names = counts.agg(F.sum(F.when(~is_large, F.col("_n"))), F.collect_list(F.when(is_large, F.struct(*keys)))).first()
    if not names:
        return shared(df, keys, rows or 0), None
    names = F.broadcast(df.sparkSession.createDataFrame(names, df.select(*keys).schema))
    return shared(df.join(names, keys, "left_anti"), keys, rows or 0), df.join(names, keys, "left_semi")


def sorted_upper(c: str) -> Column:
    """Element n//2 of a group's sorted values, for an aggregate over groups of a bounded size."""
    v = F.sort_array(F.collect_list(F.col(c).cast("double")))
    return F.get(v, F.floor(F.size(v) / 2).cast("int"))


def sorted_median(c: str) -> Column:
    """The median of a group's values, for an aggregate over groups of a bounded size; equal to that of :func:`quantiles`."""
    v = F.sort_array(F.collect_list(F.col(c).cast("double")))
    at = (F.size(v) - 1) * F.lit(0.5)
    lo, hi = F.get(v, F.floor(at).cast("int")), F.get(v, F.ceil(at).cast("int"))
    return lo + (hi - lo) * (at - F.floor(at))


def quantiles(df: DataFrame, keys: Sequence[str], value: str | Mapping[str, Mapping[str, float | str]], specs: Mapping[str, float | str] | None = None) -> DataFrame:
    """Exact order statistics per group without gathering a group, from one read whatever the number of columns.

    ``specs`` maps an output name to a fraction in 0..1 (linear interpolation between closest
    ranks), to ``"upper"`` (element n//2 of the sorted values) or to ``"count"`` (how many values there are); ``value`` names its column, or maps several columns to
    their specs. Equal values are counted before the shuffle. A histogram of the distinct ones, by tile, finds the tiles that hold
    the ranks; only there values are ranked. A group in which a column is null throughout shows null for it.
    """
    keys = as_list(keys)
    wanted = {value: dict(specs)} if isinstance(value, str) else {c: dict(s) for c, s in value.items()}
    cols = list(wanted)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)])).alias("_e")
    d = df.select(*keys, each).select(*keys, F.col("_e.c").alias("_c"), F.col("_e.v").alias("_q")) if len(cols) > 1 else df.select(*keys, F.lit(0).alias("_c"), F.col(cols[0]).alias("_q"))
    by = [*keys, "_c"]
    counts = lay_out(d.filter(F.col("_q").isNotNull()).groupBy(*by, "_q").agg(F.count("*").alias("_n")), by, "_q", value_tile("_q"))
    # the positions that are asked for, by column: (position below, position above, weight of the one above)
    n = F.col("_tot")

    def position(spec):
        return F.floor(n / 2).cast("double") if spec in ("upper", "count") else (n - 1) * F.lit(float(spec))

    asked = F.lit(None).cast("array<double>")
    for i, c in enumerate(cols):
        asked = F.when(F.col("_c") == i, F.array(*[position(x) for x in wanted[c].values()])).otherwise(asked)
    hist = counts.groupBy(*by, TILE).agg(F.sum("_n").alias("_tn"))
    w = Window.partitionBy(*by).orderBy(TILE)
    hist = hist.withColumns({"_before": F.coalesce(F.sum("_tn").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                             "_tot": F.sum("_tn").over(Window.partitionBy(*by))}).withColumn("_at", asked)
    within = lambda p: (F.col("_before") <= p) & (p < F.col("_before") + F.col("_tn"))
    hist = hist.filter(F.exists("_at", lambda p: within(F.floor(p)) | within(F.ceil(p)))).select(*by, TILE, "_before", "_tot", "_at")
    r = counts.join(hist, [*by, TILE])
    cum = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, TILE).orderBy("_q").rowsBetween(Window.unboundedPreceding, 0))
    r = r.withColumn("_cum", cum)

    def at(pos: Column) -> Column:
        return F.when((F.col("_cum") - F.col("_n") <= pos) & (pos < F.col("_cum")), F.col("_q"))

    aggs = []
    for i, c in enumerate(cols):
        for k, (name, spec) in enumerate(wanted[c].items()):
            mine = F.when(F.col("_c") == i, F.get("_at", F.lit(k)))
            if spec == "count":
                aggs.append(F.coalesce(F.max(F.when(F.col("_c") == i, n)), F.lit(0)).alias(name))
                continue
            lo, hi = F.max(at(F.floor(mine))), F.max(at(F.ceil(mine)))
            frac = F.max(mine - F.floor(mine))
            aggs.append((lo if spec == "upper" else lo + (hi - lo) * frac).alias(name))
    return r.groupBy(*keys).agg(*aggs)


def top_n(df: DataFrame, keys: Sequence[str], by: Sequence[Column], n: int | None, out: str = "rn") -> DataFrame:
    """First ``n`` rows per group, all of them (unranked) for no ``n``. Spark pushes the rank limit below the shuffle, so a hot group
    ships at most ``n`` rows per task."""
    if n is None:
        return df.withColumn(out, F.lit(None).cast("int"))
    w = Window.partitionBy(*as_list(keys)).orderBy(*by)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)
