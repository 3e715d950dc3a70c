"""Quality rules with host verdicts, in DataFrame functions only.

Each document gets its counts and the rules it fails. Failures are counted by host; the host's failure rate is
shrunk to the rate of all hosts by a beta prior that is fitted to the hosts' own rates (by moments); a host whose
shrunk rate passes the limit is strict ground: there a document goes for any rule, elsewhere for a base rule only.

Defined cases: a null text is empty; an empty text has no words and fails the base rules; a null host is the host
"" ; rows that repeat an id are judged each on its own text, and each counts for its host; further columns pass
through untouched, whatever their names.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_column

_SPACE = " \t\n\x0b\x0c\r"
_RUN = r"[ \t\n\x0B\f\r]+"
BROADCAST_HOSTS = 64 << 20      # bytes of host verdicts up to which they are broadcast, so that the documents are not shuffled


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for the row, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(_SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _RUN))


def _repeat_words(words: Column, width: int = 8) -> Column:
    """Words inside windows of ``width`` words that stand in the text twice or more."""
    starts = F.sequence(F.lit(0), F.size(words) - width)

    def covered(at: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
        return F.aggregate(at, zero, lambda a, i: F.struct((a["n"] + i + width - F.greatest(i, a["reach"])).alias("n"), (i + width).alias("reach")), lambda a: a["n"])

    def exact() -> Column:
        windows = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i + 1, width), " ").alias("w"), i.alias("i"))))
        same = lambda s, x, j: F.coalesce(F.get(s, j)["w"] == x["w"], F.lit(False))
        return bound(windows, lambda s: covered(F.array_sort(F.transform(F.filter(s, lambda x, j: same(s, x, j - 1) | same(s, x, j + 1)), lambda x: x["i"]))))

    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i + 1, width)))
    any_twice = bound(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))    # equal windows have equal hashes
    return F.when(F.size(words) <= width, 0).when(any_twice, exact()).otherwise(0)


def counts(text: Column) -> Column:
    """The struct of a text's counts."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    by_words = bound(_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    by_lines = bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    without = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")
    return F.struct(by_words.alias("w"), by_lines.alias("l"), without(_RUN).alias("word_chars"), (F.length(text) - without(r"[#*$%&|<>]+")).cast("long").alias("n_symbols"))


def _free(name: str, columns: list[str]) -> str:
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", keep_cols: list[str] | None = None, host_limit: float = 0.5) -> tuple[DataFrame, str]:
    """``keep_cols`` of ``docs`` (all by default) and one struct column with counts, rules and verdicts; its name."""
    keep = docs.columns if keep_cols is None else keep_cols
    name = _free("quality", keep)
    c = F.col(name)
    raw = docs.select(*keep, F.struct(counts(text_column(docs, text_col)).alias("c"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host")).alias(name))
    n, chars = c["c"]["w"]["n_words"], c["c"]["word_chars"]
    rules = raw.select(*keep, F.struct(
        c["host"].alias("host"), n.alias("n_words"), c["c"]["w"]["n_repeat_words"].alias("n_repeat_words"), c["c"]["l"]["n_dup_lines"].alias("n_dup_lines"), chars.alias("word_chars"), c["c"]["n_symbols"].alias("n_symbols"),
        ((n < 20) | (100 * c["c"]["w"]["n_repeat_words"] > 30 * n)).alias("base_failed"),
        ((10 * c["c"]["n_symbols"] > chars) | (10 * c["c"]["l"]["n_dup_lines"] > 3 * c["c"]["l"]["n_lines"]) | (chars < 3 * n) | (chars > 10 * n)).alias("soft_failed")).alias(name))
    rules = stored(rules, "quality")
    failed = (c["base_failed"] | c["soft_failed"]).cast("long")
    hosts = rules.groupBy(c["host"].alias("_host")).agg(F.count("*").alias("_n"), F.sum(failed).alias("_failed"))
    rate = F.col("_failed") / F.col("_n")
    size = F.sum(F.octet_length("_host") + 64).alias("size")
    fit = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), size).first()      # one row, whatever the number of hosts
    m = min(max(fit.m or 0.0, 1e-3), 1 - 1e-3)
    strength = min(max(m * (1 - m) / max(fit.v or 0.0, 1e-9) - 1, 1.0), 1e6)
    verdicts = hosts.select("_host", ((F.col("_failed") + m * strength) / (F.col("_n") + strength)).alias("_rate"))
    if (fit.size or 0) <= BROADCAST_HOSTS:                # measured; beyond it a shuffled join, where AQE splits a hot host
        verdicts = F.broadcast(verdicts)
    out = rules.join(verdicts, c["host"] == F.col("_host"), "left")
    kept = ~c["base_failed"] & ~(c["soft_failed"] & (F.col("_rate") > host_limit))
    return out.select(*keep, c.withField("host_rate", F.col("_rate")).withField("kept", kept).alias(name)), name


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    judged, name = judge(docs, text_col, host_col)
    return judged.where(F.col(name)["kept"]).select(*docs.columns)
