"""Quality and toxicity by hierarchical empirical Bayes.

Document evidence is the strongest marker of a text: words, word beginnings, trailing marks and shape classes have
log odds from labelled documents, of which at most ``TRAIN_ROWS`` are read (a bounded sample by a hash of the id; one half
gives the log odds, the other the scale that turns evidence into a probability). Everything else is over all documents:
the probabilities are averaged by path and by host, a path's mean is shrunk toward its host's and that toward the mean of
the corpus, as strongly as the spread of the sites says, and a document's odds are moved by its path's against the corpus.

Defined cases: a null text is empty; a null host or path is ""; labels of an id that differ count by their worst;
labels without an id or of unknown ids are left out; without labels of both kinds nothing is rejected for that label; rows
that repeat an id are judged each on its own text; further columns are ignored.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

TRAIN_ROWS = 20_000      # most labelled documents that are read for fitting
MOST_MARKERS = 30_000    # most log odds that are kept
LEAST_COUNT = 5          # documents in which a marker stands at least
LEAST_G = 20.0           # likelihood ratio statistic from which a marker tells labels apart
KINDS = ("toxic", "bad")
_WORD = re.compile(r"[^\W\d_]+")
_MARKS = re.compile(r"[^\w\s]{2,6}(?=\s|$)")


def _share(name: str, part: int, whole: int) -> str:
    return f"{name}{round(10 * part / whole) if whole else 0}"


def markers(text: str) -> set[str]:
    """What a text shows of itself."""
    words = text.split()
    own = set(_WORD.findall(text.lower()))
    out = set(own)
    for k in (3, 4, 5, 6):
        out.update({f"{w[:k]}-" for w in own if len(w) > k})
    out.update(map("..{}".format, set(_MARKS.findall(text))))
    lines = [x for x in text.split("\n") if x.strip()]
    out |= {_share("upper ", sum(map(str.isupper, words)), len(words)), _share("bars ", words.count("|"), len(words)), _share("distinct ", len(set(words)), len(words)), _share("lines ", len(set(lines)), len(lines)), f"length {len(words).bit_length()}"}
    return out


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _weights(sample: DataFrame) -> tuple[dict, dict]:
    """Log odds, at most MOST_MARKERS for each label, of the markers that tell the labels apart: from one half of the
    sample, for the scale, and from all of it."""
    names = [f"{k}{h}" for h in (0, 1) for k in ("n", *KINDS)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {name: Counter() for name in names}
        for batch in batches:
            rows = batch.to_pydict()
            for text, half, *labels in zip(rows["text"], rows["half"], *(rows[k] for k in KINDS)):
                own = markers(text)
                found[f"n{half}"].update(own)
                for k, v in zip(KINDS, labels):
                    if v:
                        found[f"{k}{half}"].update(own)
        keys = list(found["n0"] | found["n1"])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([found[name][m] for m in keys], pa.int64()) for name in names)], ["marker", *names])

    schema = "marker string, " + ", ".join(f"{name} long" for name in names)
    size = {r.half: r for r in sample.groupBy("half").agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in KINDS]).collect()}
    found = stored(sample.select("text", "half", *KINDS).mapInArrow(counted, schema).groupBy("marker").agg(*[F.sum(name).alias(name) for name in names]), "markers")
    out = []
    for halves in ((0,), (0, 1)):
        out.append({})
        for k in KINDS:
            total, hits = (sum(size[h][c] for h in halves if h in size) for c in ("n", k))
            if not 0 < hits < total:
                out[-1][k] = {}
                continue
            n, a = (sum(F.col(f"{c}{h}") for h in halves) for c in ("n", k))
            b, rate = n - a, hits / total
            w = F.log((a + 0.5) / (hits + 1)) - F.log((b + 0.5) / (total - hits + 1))
            g = 2 * (F.when(a > 0, a * F.log(a / (n * rate))).otherwise(0.0) + F.when(b > 0, b * F.log(b / (n * (1 - rate)))).otherwise(0.0))
            best = found.where(n >= LEAST_COUNT).select("marker", w.alias("w"), g.alias("g")).where((F.col("g") >= LEAST_G) & (F.col("w") > 0))
            out[-1][k] = {r.marker: r.w for r in best.orderBy(F.desc("g"), "marker").limit(MOST_MARKERS).collect()}
    return out[0], out[1]


def _scale(evidence: list[float], labels: list[int]) -> tuple[float, float]:
    """Slope and level of a logistic curve, by Newton steps with a light ridge."""
    x, y, theta = np.array([[e, 1.0] for e in evidence]), np.array(labels, float), np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        theta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (y - p) - 0.1 * theta)
    return float(theta[0]), float(theta[1])


def _weigher(weights: dict[str, dict[str, float]]):
    """Columns but the text, and for each label the log odds of the text's strongest marker."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [weights[k].get for k in KINDS]
        for batch in batches:
            scores = [[] for _ in KINDS]
            for text in batch.column("text").to_pylist():
                own = markers(text)
                for get, column in zip(tables, scores):
                    column.append(max((w for w in map(get, own) if w is not None), default=0.0))
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [pa.array(s, pa.float64()) for s in scores], rest + [f"e_{k}" for k in KINDS])

    return weigh


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", limit: float = 0.5) -> DataFrame:
    """``doc_id``, document probabilities and site-adjusted ones (``p_toxic``, ``p_bad``), verdicts ``toxic`` and ``kept``."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((host_col, "host"), (path_col, "path"))])
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.coalesce(F.col("toxic"), F.lit(0))).cast("int").alias("toxic"), F.max(1 - F.coalesce(F.col("quality"), F.lit(1))).cast("int").alias("bad"))
    known = known.orderBy(F.xxhash64("label_id"), "label_id").limit(TRAIN_ROWS)          # at most TRAIN_ROWS short rows: safe to broadcast
    sample = stored(rows.join(F.broadcast(known), F.col("doc_id") == F.col("label_id")).select("text", *KINDS, F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).alias("half")), "labelled")
    half_weights, weights = _weights(sample)
    held = sample.where("half = 1").select("text", *KINDS).mapInArrow(_weigher(half_weights), "toxic int, bad int, e_toxic double, e_bad double").collect()
    seen = rows.mapInArrow(_weigher(weights), f"doc_id {kind}, host string, path string, e_toxic double, e_bad double")
    probabilities = []
    for k in KINDS:
        y = [r[k] for r in held]
        if weights[k] and half_weights[k] and 0 < sum(y) < len(y):
            slope, level = _scale([r[f"e_{k}"] for r in held], y)
            probabilities.append((1 / (1 + F.exp(-(slope * F.col(f"e_{k}") + level)))).alias(f"d_{k}"))
        else:
            probabilities.append(F.lit(0.0).alias(f"d_{k}"))
    scored = stored(seen.select("doc_id", "host", "path", *probabilities), "scored")
    paths = stored(scored.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(f"d_{k}").alias(k) for k in KINDS]), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in KINDS])

    def spread(sites: DataFrame) -> dict[str, tuple[float, float]]:
        """Mean and prior strength over all sites; one row, whatever their number."""
        got = sites.agg(F.sum("n").alias("n"), *[f for k in KINDS for f in (F.sum(k).alias(k), F.var_pop(F.col(k) / F.col("n")).alias(f"v_{k}"))]).first()
        out = {}
        for k in KINDS:
            m = min(max((got[k] or 0.0) / (got["n"] or 1), 1e-6), 1 - 1e-6)
            out[k] = m, min(max(m * (1 - m) / max(got[f"v_{k}"] or 0.0, 1e-9) - 1, 1.0), 1e6)
        return out

    by_host, by_path = spread(hosts), spread(paths)
    hosts = hosts.select(F.col("host").alias("h"), *[((F.col(k) + by_host[k][0] * by_host[k][1]) / (F.col("n") + by_host[k][1])).alias(f"host_{k}") for k in KINDS])
    paths = paths.join(hosts, F.col("host") == F.col("h")).select("h", F.col("path").alias("p"), *[((F.col(k) + F.col(f"host_{k}") * by_path[k][1]) / (F.col("n") + by_path[k][1])).alias(f"path_{k}") for k in KINDS])
    out = scored.join(paths, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")))
    for k in KINDS:
        base = by_host[k][0]
        moved = _logit(F.col(f"d_{k}")) + _logit(F.col(f"path_{k}")) - math.log(base / (1 - base))
        out = out.withColumn(f"p_{k}", 1 / (1 + F.exp(-moved)))
    return out.select("doc_id", *[f"{x}_{k}" for k in KINDS for x in "dp"], (F.col("p_toxic") >= limit).alias("toxic"), ((F.col("p_toxic") < limit) & (F.col("p_bad") < limit)).alias("kept"))
