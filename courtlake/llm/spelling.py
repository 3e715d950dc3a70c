"""Spelling variants: words one edit apart, found by range searches in k-d trees over letter counts.

One inserted, deleted or replaced letter moves a word's vector of letter counts by an L1 distance of two at most: by one up and one
down between words of one length, by one down from a word to one that is a letter shorter. So each length has a k-d tree, and a
word searches the tree of its own length with one step up and one down to spend, and that of the next shorter length with one step down.
A subtree is entered only if its box can be reached with what is left. What a search finds is verified by the order of letters.

A length of many words has a tree in two storeys. The upper one is split by a sample of the words (one in ``SAMPLE``, by
hash); every word is kept in the leaf its counts lead to, and sent as a question to the leaves that its search reaches, with the
steps it has left. Each leaf is a task of its own, which builds the lower storey over its own words. A balanced leaf holds about
``LEAF_WORDS`` words whatever the size of the vocabulary, and the leaves a word reaches grow with the square of the tree's depth.
Where a length has many more words than the next shorter one, the shorter one's leaves are copied and its questions dealt among the copies.
Results leave a task as one row a word (how many are near, the best of them), never as pairs.

Defined cases: a null or wordless text has no words; the id of a null is the empty string; rows that repeat an id are read each on its
own; the same word counts wherever it stands; a word without a near one, or whose near ones are rare, is its own root; further columns are ignored.
"""
from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LEAF_WORDS = 16_384
SAMPLE = 64
BUCKET_WORDS = 8            # of a lower tree's leaf
QUESTIONS = 8192            # searched at once
LEAF_QUESTIONS = 131_072    # of longer words in one copy of a leaf, on average
TABLE_WORDS = 300_000       # distinct words a task holds before it hands them on
MISSPELT = 97               # words whose checksum it divides lose a letter
_LETTERS = [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]
#: Lower-cases A-Z and turns what is no letter (of the first 256 code points) into a space.
_TABLE = bytes((b + 32 if b < 91 else b) if b in set(_LETTERS) else 32 for b in range(256))
_DIMS = 26 + 64
_DIM = np.zeros(256, np.int64)
_DIM[97:123], _DIM[0xC0:] = range(26), range(26, _DIMS)
UP, DOWN = 1, 2             # steps that are spent
_U = np.uint64


def runs(text: str | None) -> list[bytes]:
    """Maximal runs of letters, one byte a letter; what lies beyond the first 256 code points separates them."""
    return text.encode("latin-1", "replace").translate(_TABLE).split() if text else []


def misspelt(word: bytes, seed: int) -> bytes:
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
    return word if h % MISSPELT else word[:(i := h % len(word))] + word[i + 1:]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3) -> DataFrame:
    """``word, n, size``: every word of at least ``shortest`` letters and ``least`` occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in table], pa.string()), pa.array(list(table.values()), pa.int64())], ["word", "k"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seed = zlib.crc32(f"{'' if i is None else i}:".encode())
                for word, k in Counter([w for w in runs(text.as_py()) if len(w) >= shortest]).items():
                    word = misspelt(word, seed)
                    if len(word) >= shortest:
                        table[word] += k
                if len(table) > TABLE_WORDS:
                    yield rows()
                    table.clear()
        if table:
            yield rows()

    counted = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(count, "word string, k long")
    return counted.groupBy("word").agg(F.sum("k").alias("n")).where(F.col("n") >= least).select("word", "n", F.length("word").alias("size"))


def letter_matrix(words: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(-1, size)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    n = len(letters)
    at = (np.arange(n)[:, None] * _DIMS + _DIM[letters]).ravel()
    return np.bincount(at, minlength=n * _DIMS).reshape(n, _DIMS).astype(np.int32)


@dataclass
class Tree:
    """Inner nodes split at ``count of letter >= limit``; a leaf has letter -1 and its number in ``left``."""
    letter: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    order: np.ndarray           # points by leaf
    start: np.ndarray           # of each leaf in order; one more than leaves

    def search(self, counts: np.ndarray, spent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Questions, leaves and the steps spent by then, for all leaves that the questions reach."""
        q, node, state, out = np.arange(len(counts)), np.zeros(len(counts), np.int64), spent.astype(np.int8), []
        while len(q):
            end = self.letter[node] < 0
            if end.any():
                out.append((q[end], self.left[node[end]], state[end]))
                q, node, state = q[~end], node[~end], state[~end]
            c, t = counts[q, self.letter[node]], self.limit[node]
            high = c >= t
            home, away = np.where(high, self.right[node], self.left[node]), np.where(high, self.left[node], self.right[node])
            up, down = (c == t - 1) & (state & UP == 0), (c == t) & (state & DOWN == 0)
            go = up | down
            q, node, state = np.concatenate((q, q[go])), np.concatenate((home, away[go])), np.concatenate((state, state[go] | np.where(up[go], UP, DOWN).astype(np.int8)))
        return tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8))


def grow(counts: np.ndarray, most: float) -> Tree:
    """Splits points until a leaf holds ``most`` or equal ones; each split is the most even one of any letter and limit."""
    letter, limit, left, right, order, sizes = [], [], [], [], [], []
    todo = [(np.arange(len(counts)), -1, False)]
    while todo:
        points, parent, is_right = todo.pop()
        me = len(letter)
        if parent >= 0:
            (right if is_right else left)[parent] = me
        best = None
        if len(points) > most:
            own = counts[points]
            low, high = own.min(0), own.max(0)
            dims = np.flatnonzero(low < high)
            for c in dims:
                for t in range(max(1, int(np.median(own[:, c]))), int(np.median(own[:, c])) + 2):
                    if low[c] < t <= high[c]:
                        off = abs(2 * int((own[:, c] >= t).sum()) - len(points))
                        if best is None or off < best[0]:
                            best = off, c, t
        if best is None:
            letter.append(-1), limit.append(0), left.append(len(sizes)), right.append(-1)
            order.append(points)
            sizes.append(len(points))
            continue
        _, c, t = best
        letter.append(c), limit.append(t), left.append(-1), right.append(-1)
        above = counts[points, c] >= t
        todo += [(points[above], me, True), (points[~above], me, False)]
    arrays = [np.array(x, np.int64) for x in (letter, limit, left, right)]
    return Tree(*arrays, np.concatenate(order), np.concatenate(([0], np.cumsum(sizes))))


def _upper_trees(words: DataFrame) -> dict[int, tuple[Tree, int]]:
    """Per length its tree and the copies of its leaves. A length of no more words than a leaf should hold has one leaf. The driver gets the nodes,
    a few for each ``LEAF_WORDS`` words, and the number of words of each length."""
    by_size = words.groupBy("size").agg(F.count("*").alias("n"))
    known, sizes = {r.size: r.n for r in by_size.collect()}, by_size.where(F.col("n") > LEAF_WORDS)
    sample = words.where(F.pmod(F.xxhash64("word"), F.lit(SAMPLE)) == 0).join(sizes.withColumnRenamed("n", "of"), "size").select("size", "word", "of")

    def build(group: pa.Table) -> pa.Table:
        size, n = group.column("size")[0].as_py(), group.column("of")[0].as_py()
        tree = grow(letter_counts(letter_matrix([w.encode("latin-1") for w in group.column("word").to_pylist()], size)), max(1.0, LEAF_WORDS * group.num_rows / n))
        return pa.table({"size": pa.array([size], pa.int32()), **{k: pa.array([getattr(tree, k).tobytes()], pa.binary()) for k in ("letter", "limit", "left", "right")}})

    none, single = np.zeros(0, np.int64), grow(np.zeros((1, _DIMS), np.int32), 1)
    out = dict.fromkeys(known, single)
    for r in sample.groupBy("size").applyInArrow(build, "size int, letter binary, limit binary, left binary, right binary").collect():
        out[r.size] = Tree(*(np.frombuffer(x, np.int64) for x in (r.letter, r.limit, r.left, r.right)), none, none)
    return {size: (tree, max(1, math.ceil(known.get(size + 1, 0) / (LEAF_QUESTIONS * int((tree.letter < 0).sum()))))) for size, tree in out.items()}


_POINT, _ASKS, _LONGER = 0, 1, 2
_DEALT = "size int, leaf int, copy int, kind int, spent int, word string, n long"


def _deal(words: DataFrame, trees: dict[int, tuple[Tree, int]]) -> DataFrame:
    """Every word to all copies of its leaf, and as a question to one copy of the others that its searches reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ns, sizes = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                counts = letter_counts(letter_matrix([names[i].as_py().encode("latin-1") for i in at.tolist()], size))
                parts = []
                for tree_size, kind, spent in ((size, _POINT, UP | DOWN), (size, _ASKS, 0), (size - 1, _LONGER, UP)):
                    if tree_size not in trees:
                        continue
                    tree, copies = trees[tree_size]
                    q, leaf, state = tree.search(counts, np.full(len(at), spent))
                    copy = np.zeros(len(q), np.int32)
                    if kind == _ASKS:                   # in its own leaf the word itself is the question
                        away = leaf != home[q]
                        q, leaf, state, copy = q[away], leaf[away], state[away], copy[away]
                    elif kind == _POINT:
                        home = np.empty(len(at), np.int64)
                        home[q] = leaf
                        copy = np.tile(np.arange(copies, dtype=np.int32), len(q))
                        q, leaf, state = (np.repeat(x, copies) for x in (q, leaf, state))
                    else:
                        copy = (at[q] % copies).astype(np.int32)
                    parts.append((at[q], np.full(len(q), tree_size, np.int32), leaf.astype(np.int32), copy, np.full(len(q), kind, np.int32), state.astype(np.int32)))
                row, tree_size, leaf, copy, kind, state = map(np.concatenate, zip(*parts))
                yield pa.RecordBatch.from_arrays([*map(pa.array, (tree_size, leaf, copy, kind, state)), names.take(pa.array(row)), pa.array(ns[row])], ["size", "leaf", "copy", "kind", "spent", "word", "n"])

    return words.select("word", "n", "size").mapInArrow(run, _DEALT)


def _thermometer(counts: np.ndarray) -> np.ndarray:
    """64 bits of the counts: one edit changes two of them at most."""
    bits = np.zeros((len(counts), 64), np.uint8)
    bits[:, :26], bits[:, 26:52] = counts[:, :26] >= 1, counts[:, :26] >= 2
    for k in range(12):
        bits[:, 52 + k] = counts[:, 26 + k::12].any(1)
    return np.packbits(bits, axis=1).view(_U).ravel()


def _half_hashes(letters: np.ndarray, first: int, second: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the letters before ``first`` and from ``second`` on."""
    def fold(part: np.ndarray) -> np.ndarray:
        h = np.full(len(part), 0x9E3779B97F4A7C15, _U)
        for column in part.T:
            h = (h ^ column) * _U(0x100000001B3)
        return h

    return fold(letters[:, :first]), fold(letters[:, second:])


class _Points:
    """The words of one leaf, their lower tree, and what is compared before letters are."""

    def __init__(self, words: list[bytes], size: int):
        self.size, self.letters = size, letter_matrix(words, size)
        counts = letter_counts(self.letters)
        self.tree, self.code = grow(counts, BUCKET_WORDS), _thermometer(counts)
        self.halves = _half_hashes(self.letters, size // 2, size // 2)

    def near(self, letters: np.ndarray, spent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Questions and points one edit apart, for questions of this length or one more."""
        longer = letters.shape[1] - self.size
        for s in range(0, len(letters), QUESTIONS):
            part = letters[s:s + QUESTIONS]
            counts = letter_counts(part)
            code, halves = _thermometer(counts), _half_hashes(part, self.size // 2, self.size // 2 + longer)
            q, leaf, _ = self.tree.search(counts, spent[s:s + QUESTIONS])
            n = self.tree.start[leaf + 1] - self.tree.start[leaf]
            ends = np.cumsum(n)
            for lo, hi in _slices(ends, 4_000_000):
                m = n[lo:hi]
                asks = np.repeat(q[lo:hi], m)
                p = self.tree.order[np.arange(len(asks)) + np.repeat(self.tree.start[leaf[lo:hi]] - np.cumsum(m) + m, m)]
                maybe = np.bitwise_count(code[asks] ^ self.code[p]) <= 2
                asks, p = asks[maybe], p[maybe]
                maybe = (halves[0][asks] == self.halves[0][p]) | (halves[1][asks] == self.halves[1][p])
                asks, p = asks[maybe], p[maybe]
                step = max(1, 20_000_000 // letters.shape[1])
                for k in range(0, len(asks), step):
                    a, b = asks[k:k + step], p[k:k + step]
                    hit = one_edit(part[a], self.letters[b])
                    yield a[hit] + s, b[hit]


def _slices(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``most`` by the running totals ``ends``."""
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def one_edit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of ``x`` and ``y`` one edit apart; those of ``x`` have as many letters as ``y`` or one more."""
    if x.shape[1] == y.shape[1]:
        return (x != y).sum(1) == 1
    same_left = np.cumprod(x[:, :-1] == y, axis=1, dtype=np.int32).sum(1)
    same_right = np.cumprod((x[:, 1:] == y)[:, ::-1], axis=1, dtype=np.int32).sum(1)
    return same_left + same_right >= y.shape[1]


def _match(group: pa.Table) -> pa.Table:
    """One row a word that stands here or asks here: how many are near, and the best of them."""
    size = group.column("size")[0].as_py()
    kinds, spent, ns = (group.column(c).to_numpy() for c in ("kind", "spent", "n"))
    names = [w.encode("latin-1") for w in group.column("word").to_pylist()]
    rank = np.empty(len(names), np.int64)
    by_rank = sorted(range(len(names)), key=lambda i: (-ns[i], names[i]))
    rank[by_rank] = range(len(names))
    by_rank = np.array(by_rank)
    near, best = np.zeros(len(names), np.int64), np.full(len(names), len(names), np.int64)
    points = np.flatnonzero(kinds == _POINT)
    if len(points):
        here = _Points([names[i] for i in points.tolist()], size)

        def found(whom: np.ndarray, what: np.ndarray) -> None:
            np.add.at(near, whom, 1)
            np.minimum.at(best, whom, rank[what])

        same = np.concatenate((points, np.flatnonzero(kinds == _ASKS))) if group.column("copy")[0].as_py() == 0 else points[:0]
        for asks, length in ((same, size), (np.flatnonzero(kinds == _LONGER), size + 1)):
            if len(asks):
                budget = np.where(kinds[asks] == _POINT, 0, spent[asks])
                for a, p in here.near(letter_matrix([names[i] for i in asks.tolist()], length), budget):
                    found(asks[a], points[p])
                    if length > size:
                        found(points[p], asks[a])
    keep = np.flatnonzero((kinds == _POINT) | (near > 0))
    has = near[keep] > 0
    top = by_rank[np.where(has, best[keep], 0)]
    words = group.column("word").combine_chunks()
    return pa.table({
        "word": words.take(pa.array(keep)), "n": pa.array(ns[keep]), "near": pa.array(near[keep]),
        "top_n": pa.array(ns[top], mask=~has), "top": words.take(pa.array(top, mask=~has))})


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, n_near, top_n, top`` for a stored vocabulary: how many words are one edit away, and the most frequent of
    them (ties: the first in code-point order)."""
    found = _deal(words, _upper_trees(words)).groupBy("size", "leaf", "copy").applyInArrow(_match, "word string, n long, near long, top_n long, top string")
    first = F.min(F.when(F.col("top").isNotNull(), F.struct((-F.col("top_n")).alias("n"), F.col("top").alias("word"))))
    best = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), first.alias("f"))
    return best.select("word", "n", "n_near", (-F.col("f.n")).alias("top_n"), F.col("f.word").alias("top"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: each round doubles the way that a word has come. A form is at least twice as frequent
    as its word, so ways are short and never closed."""
    at = forms.select("word", F.col("form").alias("root"))
    top = forms.agg(F.max("form_n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(math.log2(top) + 2))):
        far = at.select(F.col("word").alias("via"), F.col("root").alias("far"))
        moved = at.join(far, F.col("root") == F.col("via"), "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved"))
        moved = stored(moved, "roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return at


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3, ratio: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: a word's form is its most frequent near word, if that is ``ratio`` times as frequent."""
    words = stored(vocabulary(docs, id_col, text_col, shortest, least), "words")
    common = F.col("top_n") >= ratio * F.col("n")
    named = stored(near_words(words).select("word", "n", "n_near", F.when(common, F.col("top")).alias("form"), F.when(common, F.col("top_n")).alias("form_n")), "forms")
    roots = _roots(named.where("form is not null").select("word", "form", "form_n"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
