"""Benchmark decontamination over a distributed positional inverted index.

The index is cut by document: each segment holds the postings of a few million words, sorted by term, so
building it needs no shuffle and asking it needs none either. A phrase is looked up from its rarest word in
the whole corpus: the posting list of that word, moved back by the word's place in the phrase, is intersected
with the moved lists of the next rarer words until it is empty or all words agree.

Terms are 64-bit hashes of the words. Benchmark texts come to the tasks in blocks of a bounded size, one pass
over the index for each block, so a larger benchmark means more passes and never a larger broadcast.

Defined cases: a null or wordless text has no words and no matches; a null item id counts as the empty id; rows
that repeat a document id are judged each on its own text and give one row each; further columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, shards_for, stored

WINDOW = 13
SEGMENT_WORDS = 2_000_000
GAP = 64  # between two documents of a segment, longer than any window and its slop

_INDEX = "segment long, ids array<{t}>, lengths array<int>, terms binary, counts binary, gaps binary"
_SPAN = "array<struct<start:int,end:int,item:string,kind:string>>"


class _Hashes(dict):
    """Hash by word; forgotten when it holds too many words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _hashed(words: list[bytes], hashes: _Hashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The stored index: one row per segment with its documents, their lengths, and all postings by term."""
    kind = docs.schema[id_col].dataType.simpleString()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, parts, held, n, idtype = _Hashes(), [], [], 0, 0, None
        base = TaskContext.get().partitionId() << 33

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(p) for p in parts], np.int64)
            starts = np.concatenate(([0], np.cumsum(lengths + GAP)))[:-1]
            terms = np.concatenate(parts)
            places = np.concatenate([np.arange(s, s + k) for s, k in zip(starts, lengths)]) if len(terms) else np.zeros(0, np.int64)
            order = np.argsort(terms, kind="stable")                 # places stay in order within a term
            terms, places = terms[order], places[order]
            first = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.zeros(0, np.int64)
            gaps = np.diff(places, prepend=0)
            gaps[first] = places[first]
            row = [[base + n], [ids], [lengths.tolist()], [terms[first].tobytes()], [np.diff(first, append=len(terms)).astype(np.uint32).tobytes()], [gaps.astype(np.uint32).tobytes()]]
            types = [pa.int64(), pa.list_(idtype), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], ["segment", "ids", "lengths", "terms", "counts", "gaps"])

        for batch in batches:
            idtype = batch.schema.field(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = _hashed(alnum_words(text), hashes)
                ids.append(i)
                parts.append(w)
                held += len(w) + GAP
                if held >= segment_words:
                    yield flush()
                    ids, parts, held, n = [], [], 0, n + 1
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(segments, _INDEX.format(t=kind))
    return stored(rows, "postings")


def _phrases(items: list[tuple[str, str]], window: int) -> tuple[np.ndarray, list[tuple[tuple[int, ...], list[str]]]]:
    """Distinct windows as term tuples with the items that hold them, and all terms."""
    hashes, found = _Hashes(), {}
    for item, text in items:
        terms = _hashed(alnum_words(text), hashes).tolist()
        k = min(window, len(terms))
        for i in range(len(terms) - k + 1 if k else 0):
            found.setdefault(tuple(terms[i:i + k]), set()).add(item)
    windows = [(w, sorted(s)) for w, s in sorted(found.items())]
    return np.unique(np.array([t for w, _ in windows for t in w], np.uint64)), windows


def _corpus_counts(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """How often each asked term stands in the corpus; at most one row per term of the block comes back."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own, n = np.frombuffer(t, np.uint64), np.frombuffer(c, np.uint32)
                _, mine, _ = np.intersect1d(own, terms, assume_unique=True, return_indices=True)
                yield pa.RecordBatch.from_arrays([pa.array(own[mine].view(np.int64)), pa.array(n[mine].astype(np.int64))], ["term", "n"])

    got = index.select("terms", "counts").mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {int(np.int64(r.term).view(np.uint64)): r.n for r in got}


def _plans(windows, counts: dict[int, int]) -> list[tuple[list[int], list[int], int, list[str]]]:
    """Each window that can occur, as its terms from the rarest on, their offsets, its length and its items."""
    plans = []
    for w, items in windows:
        if all(t in counts for t in w):
            order = sorted(range(len(w)), key=lambda i: (counts[w[i]], i))
            plans.append(([w[i] for i in order], order, len(w), items))
    return plans


def _ask(index: DataFrame, plans, near_plans, slop: int, kind: str) -> DataFrame:
    """One row per document of the index with its spans."""

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarest = np.array([p[0][0] for p in plans], np.uint64)
        near_rarest = np.array([p[0][0] for p in near_plans], np.uint64)
        for batch in batches:
            for segment, ids, lengths, t, c, g in zip(*(batch.column(i) for i in range(6))):
                lengths = np.array(lengths.as_py(), np.int64)
                starts = np.concatenate(([0], np.cumsum(lengths + GAP)))[:-1]
                terms, ends = np.frombuffer(t.as_py(), np.uint64), np.cumsum(np.frombuffer(c.as_py(), np.uint32).astype(np.int64))
                gaps, lists = np.frombuffer(g.as_py(), np.uint32), {}

                def places(term):
                    if term not in lists:
                        i = np.searchsorted(terms, np.uint64(term))
                        here = i < len(terms) and terms[i] == term
                        lists[term] = np.cumsum(gaps[ends[i - 1] if i else 0:ends[i]].astype(np.int64)) if here else np.zeros(0, np.int64)
                    return lists[term]

                spans = [[] for _ in lengths]

                def found(at, length, items, how):
                    for d, s in zip((np.searchsorted(starts, at, "right") - 1).tolist(), at.tolist()):
                        s -= int(starts[d])
                        spans[d] += [(item, how, s, s + length) for item in items]

                exact = {}
                for k in np.flatnonzero(np.isin(rarest, terms)):
                    order, offsets, length, items = plans[k]
                    at = places(order[0]) - offsets[0]
                    for term, o in zip(order[1:], offsets[1:]):
                        if not len(at):
                            break
                        have = places(term)
                        if not len(have):
                            at = have
                            break
                        i = np.minimum(np.searchsorted(have, at + o), len(have) - 1)
                        at = at[have[i] == at + o]
                    if len(at):
                        exact[tuple(order), tuple(offsets)] = at
                        found(at, length, items, "phrase")
                for k in np.flatnonzero(np.isin(near_rarest, terms)):
                    order, offsets, length, items = near_plans[k]
                    at = places(order[0]) - offsets[0]
                    doc = np.searchsorted(starts, at + offsets[0], "right") - 1
                    low, high = starts[doc], starts[doc] + lengths[doc]
                    for term, o in zip(order[1:3], offsets[1:3]):
                        have = places(term)
                        at, low, high = (x[np.searchsorted(have, at + o + slop, "right") > np.searchsorted(have, at + o - slop)] for x in (at, low, high))
                    same = exact.get((tuple(order), tuple(offsets)))
                    keep = (at >= low) & (at + length <= high)
                    if same is not None:
                        keep &= ~np.isin(at, same)
                    found(at[keep], length, items, "near")
                out = []
                for own in spans:
                    merged = []
                    for item, how, s, e in sorted(own):                  # windows of one item that touch are one span
                        if merged and merged[-1][:2] == [item, how] and s <= merged[-1][3]:
                            merged[-1][3] = max(e, merged[-1][3])
                        else:
                            merged.append([item, how, s, e])
                    out.append([{"start": s, "end": e, "item": item, "kind": how} for item, how, s, e in merged])
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("item", pa.string()), ("kind", pa.string())]))
                n = len(lengths)
                yield pa.RecordBatch.from_arrays([pa.array([segment.as_py()] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), ids.values, pa.array(lengths), pa.array(out, span)], ["segment", "no", "doc_id", "n_words", "spans"])

    return index.mapInArrow(matched, f"segment long, no int, doc_id {kind}, n_words long, spans {_SPAN}")


def find_matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = 0, block_bytes: int = 4_000_000) -> DataFrame:
    """``doc_id, n_words, spans`` for every row of ``docs``: exact phrases, and with ``slop`` above 0 also places
    where the three rarest words of a window stand within ``slop`` words of where the phrase has them."""
    if not 0 <= slop < GAP - window:
        raise ValueError(f"slop must lie between 0 and {GAP - window - 1}")
    kind = docs.schema[id_col].dataType.simpleString()
    index = build_index(docs, id_col, text_col)
    items = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = shards_for(size, block_bytes)
    found = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).distinct().collect()
        terms, windows = _phrases([(r.item, r.text) for r in part], window)
        plans = _plans(windows, _corpus_counts(index, terms))
        one = _ask(index, plans, [p for p in plans if p[2] >= 3] if slop else [], slop, kind)
        found = one if found is None else found.unionByName(one)
    if blocks > 1:
        found = found.groupBy("segment", "no").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"))
    return found.select("doc_id", "n_words", "spans")


def judge(matches: DataFrame, share: int = 20) -> DataFrame:
    """Words hit, items found and the verdict: contaminated when at least one word in ``share`` is hit."""
    exact = F.array_sort(F.filter("spans", lambda s: s["kind"] == "phrase"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    union = F.aggregate(exact, start, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["reach"]))).alias("n"), F.greatest(a["reach"], s["end"]).alias("reach")), lambda a: a["n"].cast("long"))
    names = lambda how: F.array_sort(F.array_distinct(F.transform(F.filter("spans", lambda s: s["kind"] == how), lambda s: s["item"])))
    out = matches.select("*", union.alias("n_hit"), names("phrase").alias("items"), names("near").alias("near_items"))
    return out.select("*", F.size("items").cast("long").alias("n_items"), ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents of which any row is contaminated; a null id counts as an id."""
    bad = judge(find_matches(docs, bench, id_col, text_col)).where("contaminated").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("_bad")), "left_anti")
