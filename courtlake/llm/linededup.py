"""Repeated passages, by content-defined chunks of lines.

``dedup_passages`` is the whole job. Lines, their sentences and, within these, places that the words choose (the least
hash of every ``NEAR`` neighbouring words) are its units, so that a unit holds ``NEAR`` words at most and is cut alike
wherever it stands. A rolling hash over the hashes of two neighbouring units chooses where a chunk starts: the edge of
least hash among those of every ``WITHIN`` neighbouring words. A chunk is two units or more and ``LEAST_WORDS`` words at
least. Two places that share ``SURE`` words share a whole chunk, however they lie in lines or sentences: ``NEAR`` words
at either end may be cut otherwise, any ``WITHIN`` words between hold an edge, and a chunk ends ``LEAST_WORDS + NEAR - 1``
words behind it at most. A chunk that stood before is compared with its first place word by word, along with ``REACH``
words to both sides; every stretch of ``LEAST_WORDS`` equal words or more goes, the first place stays. Every word that
goes is thus held by an earlier place. Words are what white space parts; the white space itself is not compared.

``dedup_lines`` is the step by chunks alone:

A text is a run of lines; a long line counts as the run of its sentences. A rolling hash over the hashes of two
neighbouring lines chooses where a chunk ends, so a passage is cut alike wherever it stands. A chunk of two lines or
more that stands in the corpus twice or more stays at its first place (by document id, then by place) and goes
everywhere else. Equal hashes alone remove nothing: the bytes of all chunks under one hash are compared, and chunks
whose bytes differ stay.

Defined cases: a null text stays null and an empty one empty; a null id sorts first; rows equal in id and text share
one fate; a text may become empty; further columns pass through untouched, whatever their names.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LONG_LINE = 300      # characters from which a line counts as its sentences
LEAST_UNITS, MOST_UNITS, LEAST_WORDS = 2, 12, 12
NEAR, SURE = 4, 51        # most words of a unit; words from which a repeat is found wherever it stands
WITHIN = SURE - LEAST_WORDS - 3 * NEAR + 3     # neighbouring words of which one starts a chunk
REACH = WITHIN + 2 * NEAR                      # words beside a chunk that hold no other chunk of the same passage at most
BLOCK = 32                # words of the pieces in which first places are sent
STRIDE = 256              # chunks of one shift are compared together as far as they start in one stretch of so many words
GROUP = 1 << 20           # words of texts that are cut in one go
_ROLL, _MASK = 0x9E3779B97F4A7C15, 0xFFFFFFFFFFFFFFFF


def units(text: str) -> list[str]:
    """Lines, and sentences of long lines, with what ends them: joined they are the text."""
    out = []
    for line in text.split("\n"):
        if len(line) > LONG_LINE:
            parts = line.split(". ")
            out += [p + ". " for p in parts[:-1]]
            line = parts[-1]
        out.append(line + "\n")
    out[-1] = out[-1][:-1]
    return out


def chunks(parts: list[str]) -> list[tuple[int, int]]:
    """Bounds of the chunks of ``parts``."""
    out, start, before = [], 0, 0
    for i, p in enumerate(parts, 1):
        h = xxhash.xxh3_64_intdigest(p.strip())
        rolled = (before * _ROLL + h) & _MASK
        before = h
        if i - start >= LEAST_UNITS and (not (rolled * _ROLL & _MASK) >> 63 or i - start >= MOST_UNITS):
            out.append((start, i))
            start = i
    if start < len(parts):
        out.append((start, len(parts)))
    return out


def _body(parts: list[str], a: int, b: int) -> str:
    return "".join(parts[a:b]).strip()


def _eligible(parts: list[str], a: int, b: int, body: str) -> bool:
    return sum(1 for p in parts[a:b] if p.strip()) >= LEAST_UNITS and len(body.split(None, LEAST_WORDS)) >= LEAST_WORDS


def _hash(body: str) -> int:
    return xxhash.xxh3_64_intdigest(body) - (1 << 63)


def _free(name: str, columns: list[str]) -> str:
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with repeated passages taken out of ``text_col``, and a column that counts them; its name."""
    columns = docs.columns
    row, marks, removed = (_free(n, columns) for n in ("_row", "_marks", "n_removed"))
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.withColumn(row, F.hash(F.col(id_col), F.col(text_col)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, at, nos = [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                if text:
                    parts = units(text)
                    for no, (a, b) in enumerate(chunks(parts)):
                        if b - a >= LEAST_UNITS and _eligible(parts, a, b, body := _body(parts, a, b)):
                            hs.append(_hash(body))
                            at.append(k)
                            nos.append(no)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array(nos, pa.int32())], ["h", "id", "row", "no"])

    places = stored(docs.select(id_col, row, F.col(text_col).cast("string")).mapInArrow(cut, f"h long, id {kind}, row int, no int"), "chunks")
    here = F.struct("id", "row", "no")
    twice = places.groupBy("h").agg(F.count("*").alias("n"), F.min(here).alias("first")).where("n > 1").select(F.col("h").alias("h2"), "first")
    drop = ~here.eqNullSafe(F.col("first"))
    found = places.join(twice, F.col("h") == F.col("h2")).groupBy(F.col("id").alias("_id"), F.col("row").alias("_r")).agg(F.collect_set(F.struct("no", "h", drop.alias("drop"))).alias(marks))
    marked = docs.join(found, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col(row) == F.col("_r")), "left").select(*columns, row, marks)
    marked = stored(marked, "marked")

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {}
            for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = units(text)
                cuts = chunks(parts)
                for m in own:
                    seen.setdefault((m["h"], _body(parts, *cuts[m["no"]])))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.int64()), pa.array([b for _, b in seen], pa.string())], ["h", "body"])

    compared = marked.where(F.col(marks).isNotNull()).select(F.col(text_col).cast("string"), marks).mapInArrow(bodies, "h long, body string")
    unequal = compared.groupBy("h").agg(F.min("body").alias("a"), F.max("body").alias("b")).where("a <> b").select("h")
    unequal = stored(unequal, "unequal")
    if not unequal.isEmpty():                                                   # two texts under one hash: none of them goes
        spared = marked.select(F.col(id_col).alias("_id"), F.col(row).alias("_r"), F.explode(marks).alias("m")).join(unequal, F.col("m.h") == unequal["h"], "left_semi")
        spared = spared.groupBy("_id", "_r").agg(F.collect_set("m.h").alias("_spared"))
        marked = marked.join(spared, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col(row) == F.col("_r")), "left").withColumn(marks, F.when(F.col("_spared").isNull(), F.col(marks)).otherwise(F.filter(marks, lambda m: ~F.array_contains("_spared", m["h"])))).select(*columns, row, marks)
    gone = F.array_sort(F.transform(F.filter(F.coalesce(F.col(marks), F.array()), lambda m: m["drop"]), lambda m: m["no"]))
    where = columns.index(text_col)

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = batch.column(where).to_pylist(), batch.column(len(columns)).to_pylist()
            for k, own in enumerate(n):
                if own:
                    parts = units(texts[k])
                    cuts = chunks(parts)
                    for no in own:
                        a, b = cuts[no]
                        parts[a:b] = [""] * (b - a)
                    texts[k] = "".join(parts).rstrip("\n")
            arrays = [batch.column(i) if i != where else pa.array(texts, pa.string()) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([len(own) for own in n], pa.int32())], [*columns, removed])

    schema = docs.select(*columns).withColumn(text_col, F.col(text_col).cast("string")).withColumn(removed, F.lit(0)).schema
    return marked.select(*[F.col(c).cast("string") if c == text_col else F.col(c) for c in columns], gone.alias(removed)).mapInArrow(without, schema), removed


_WORD = re.compile(r"\S+")
_ENOUGH = b"\1" * LEAST_WORDS
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")       # beyond ASCII, what str.split parts words by
_SPACE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
_MARK, _WIDE_MARK = np.isin(np.arange(256), list(b".!?")), "。".encode()
_BYTE = np.fromiter((xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)), np.uint64, 256)
_SLICE = 1 << 20          # bytes of words that are hashed in one go


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


@cache
def _slice_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_ROLL, _SLICE), _powers(pow(_ROLL, -1, _MASK + 1), _SLICE)


def _word_hashes(raw: np.ndarray, first: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """A polynomial hash of the bytes of each word."""
    out, i = np.empty(len(first), np.uint64), 0
    with np.errstate(over="ignore"):
        while i < len(first):
            j = max(int(np.searchsorted(behind, first[i] + _SLICE, "right")), i + 1)
            a, b = first[i], behind[j - 1]
            up, down = _slice_powers() if b - a <= _SLICE else (_powers(_ROLL, int(b - a)), None)      # one word of more bytes than a slice
            terms = _BYTE[raw[a:b]] * up[:b - a]
            terms[_SPACE[raw[a:b]]] = 0
            sums = np.add.reduceat(terms, first[i:j] - a)
            out[i:j] = _mixed(sums * down[first[i:j] - a] if down is not None else sums)
            i = j
    return out


def _mixed(keys: np.ndarray) -> np.ndarray:
    keys = keys ^ (keys >> np.uint64(31))
    keys *= np.uint64(0xBF58476D1CE4E5B9)
    return keys ^ (keys >> np.uint64(29))


def _over(keys: np.ndarray, reach: int, best) -> np.ndarray:
    """Least or greatest of every ``reach`` neighbouring keys, by doubling."""
    width = 1
    while 2 * width <= reach:
        keys = best(keys[:-width], keys[width:])
        width *= 2
    return best(keys[:len(keys) - (reach - width)], keys[reach - width:]) if width < reach else keys


def _least_in_reach(keys: np.ndarray, reach: int, real: np.ndarray) -> np.ndarray:
    """Which keys are the least of some ``reach`` neighbouring ones of one text (``real``; of all of a shorter text); keys of ``_MASK`` never are."""
    whole = real.copy()
    whole[:-(reach - 1)] &= real[reach - 1:]                           # texts lie further apart than they reach
    whole[1:] |= real[1:] & ~real[:-1]
    whole[0] = real[0]
    least = _over(np.concatenate((keys, np.full(reach - 1, _MASK, np.uint64))), reach, np.minimum)
    least[~whole] = 0
    most = _over(np.concatenate((np.zeros(reach - 1, np.uint64), least)), reach, np.maximum)      # over the windows that hold a key
    return (most == keys) & (keys != np.uint64(_MASK))


def cut_chunks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of all texts: number of the text, first word, number of words, hash."""
    own = [(t if t.isascii() else _WIDE_SPACE.sub(" ", t)).encode() + b"\n" for t in texts]
    raw = np.frombuffer(b"".join(own), np.uint8)
    space = np.concatenate(([True], _SPACE[raw]))                      # one further to the right
    first, behind = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])      # bytes of the words
    n, none = len(first), np.empty(0, np.int64)
    if not n:
        return none, none, none, none
    ends_text = np.searchsorted(first, np.cumsum([len(t) for t in own]))
    sizes = np.diff(ends_text, prepend=0)
    of = np.repeat(np.arange(len(texts)), sizes)                       # each text is followed by words that choose nothing
    at = np.arange(n) + of * WITHIN
    total = n + len(texts) * WITHIN
    hashes = _word_hashes(raw, first, behind)
    padded = np.full(total, _MASK, np.uint64)
    real = np.zeros(total, bool)
    real[at] = True
    padded[at] = _mixed(hashes) >> np.uint64(1)
    last = _least_in_reach(padded, NEAR, real)[at]                     # words that end a unit
    last |= _MARK[raw[behind - 1]]
    if (wide := np.flatnonzero(raw[behind - 1] == _WIDE_MARK[2])).size:
        last[wide] |= (raw[np.maximum(behind[wide] - 3, 0)] == _WIDE_MARK[0]) & (raw[np.maximum(behind[wide] - 2, 0)] == _WIDE_MARK[1])
    lines = np.searchsorted(first, np.flatnonzero(raw == 10))
    last[lines[lines > 0] - 1] = True
    edges = np.concatenate(([0], np.flatnonzero(last) + 1))            # units lie between neighbouring edges
    with np.errstate(over="ignore"):
        power, back = _powers(_ROLL, n + 1), _powers(pow(_ROLL, -1, _MASK + 1), n + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power[:-1])))
        unit = _mixed((sums[edges[1:]] - sums[edges[:-1]]) * back[edges[:-1]])
        rolled = _mixed(unit[:-1] * np.uint64(_ROLL) + unit[1:]) >> np.uint64(1)
    within = edges[2:] <= ends_text[of[edges[:-2]]]                         # both units lie in one text
    padded[:] = _MASK
    padded[at[edges[:-2][within]]] = rolled[within]
    starts = np.flatnonzero(_least_in_reach(padded, WITHIN, real)[at])
    k = np.searchsorted(edges, starts)
    stop = np.maximum(k + LEAST_UNITS, np.searchsorted(edges, starts + LEAST_WORDS))
    fits = stop < len(edges)
    starts, stop = starts[fits], edges[stop[fits]]
    fits = stop <= ends_text[of[starts]]           # a chunk ends in its own text
    starts, stop = starts[fits], stop[fits]
    with np.errstate(over="ignore"):
        h = _mixed((sums[stop] - sums[starts]) * back[starts])
    by = np.lexsort((starts, h, of[starts]))                           # of equal chunks that overlap ("a a a a ..."), one in its own length
    h, starts, size = h[by], starts[by], (stop - starts)[by]
    chain = np.concatenate(([True], (h[1:] != h[:-1]) | (starts[1:] - starts[:-1] >= size[1:]) | (of[starts[1:]] != of[starts[:-1]])))[:len(h)]
    step = (starts - starts[np.maximum.accumulate(np.where(chain, np.arange(len(h)), 0))]) // np.maximum(size, 1)
    one = chain | np.concatenate(([True], step[1:] != step[:-1]))[:len(h)]
    h, starts, size = h[one], starts[one], size[one]
    return of[starts], starts - np.concatenate(([0], ends_text))[of[starts]], size, h.view(np.int64)


def _grouped(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts that can hold a chunk, in groups of some ``GROUP`` words."""
    at, group, size = [], [], 0
    for k, text in enumerate(texts):
        if text:
            at.append(k)
            group.append(text)
            size += len(text)
            if size >= 6 * GROUP:
                yield at, group
                at, group, size = [], [], 0
    if at:
        yield at, group


def _take_out(text: str, own: list[tuple], pieces: list[tuple], me: tuple) -> tuple[str, int]:
    """``text`` without what its stretches (lo, hi, shift, sid, srow) repeat of the pieces (sid, srow, b, piece), and how many passages went."""
    words = text.split()
    first, gone = {}, bytearray(len(words))
    for sid, srow, b, piece in pieces:
        first[sid, srow, b] = piece.split(" ")
    for lo, hi, shift, sid, srow in own:
        if (sid, srow) == me and shift < LEAST_WORDS:
            continue                                        # it overlaps its own first place
        a, z = max(lo - REACH, shift, 0), min(hi + REACH, len(words))
        theirs = []
        for b in range((a - shift) // BLOCK, (z - shift - 1) // BLOCK + 1):
            piece = first.get((sid, srow, b), ())
            theirs += piece
            theirs += [None] * (BLOCK - len(piece))
        skip = (a - shift) % BLOCK
        same = bytes(map(eq, words[a:z], theirs[skip:skip + z - a]))
        i = same.find(_ENOUGH)
        while i >= 0:
            j = same.find(b"\0", i)
            j = len(same) if j < 0 else j
            gone[a + i:a + j] = b"\1" * (j - i)
            i = same.find(_ENOUGH, j)
    if 1 not in gone:
        return text, 0
    if 0 not in gone:
        return "", 1
    spans = [m.span() for m in _WORD.finditer(text)]
    out, kept_to, count, i = [], 0, 0, 0
    while (a := gone.find(1, i)) >= 0:
        b = gone.find(0, a)
        b = len(words) if b < 0 else b
        before = text[spans[a - 1][1] if a else 0:spans[a][0]]
        after = text[spans[b - 1][1]:spans[b][0] if b < len(words) else len(text)]
        out.append(text[kept_to:spans[a][0] - len(before)])
        if a and b < len(words):
            out.append(before if "\n" in before or "\n" not in after else after)
        kept_to, i, count = spans[b - 1][1] + len(after), b, count + 1
        if b == len(words):
            break
    return "".join(out) + text[kept_to:], count


def _rows_of(column: pa.Array, *fields: str) -> Iterator[list[tuple]]:
    """The structs of each list of a column, as tuples of ``fields``; none for a null."""
    inner, ends = column.flatten(), np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).tolist()
    rows = list(zip(*(inner.field(inner.type.get_field_index(f)).to_pylist() for f in fields)))
    return (rows[a:b] for a, b in zip(ends, ends[1:]))


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with repeated passages taken out of ``text_col``, and a column that counts them; its name."""
    columns = docs.columns
    row, marks, found_pieces, removed = (_free(n, columns) for n in ("_row", "_marks", "_pieces", "n_removed"))
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.withColumn(row, F.xxhash64(F.col(id_col), F.col(text_col)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, texts in _grouped(batch.column(2).to_pylist()):
                of, at, n, h = cut_chunks(texts)
                rows = pa.array(np.array(held, np.int64)[of])
                yield pa.RecordBatch.from_arrays([pa.array(h), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "id", "row", "at", "n"])

    places = stored(docs.select(id_col, row, F.col(text_col).cast("string")).mapInArrow(cut, f"h long, id {kind}, row long, at int, n int"), "chunks")
    often = stored(places.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select(F.col("h").alias("h2")), "often")      # hashes alone, as most places are single
    places = stored(places.join(often, F.col("h") == F.col("h2"), "left_semi"), "repeated")
    here = F.struct("id", "row", "at")
    twice = stored(places.groupBy("h").agg(F.min(here).alias("first")).select(F.col("h").alias("h2"), F.col("first.id").alias("sid"), F.col("first.row").alias("srow"), F.col("first.at").alias("sat")), "first")      # a join of its own, so that Spark can split a common hash
    goes = ~(F.col("id").eqNullSafe(F.col("sid")) & (F.col("row") == F.col("srow")) & (F.col("at") == F.col("sat")))
    pairs = places.join(twice, F.col("h") == F.col("h2")).withColumns({"shift": F.col("at") - F.col("sat"), "part": F.floor(F.col("at") / STRIDE).cast("int"), "drop": goes})
    runs = stored(pairs.groupBy("id", "row", "sid", "srow", "shift", "part", "drop").agg(F.min("at").alias("lo"), F.max(F.col("at") + F.col("n")).alias("hi")), "runs")
    found = runs.groupBy(F.col("id").alias("_id"), F.col("row").alias("_r")).agg(F.collect_list(F.struct("lo", "hi", "shift", "sid", "srow", "drop")).alias(marks))
    marked = stored(docs.join(found, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col(row) == F.col("_r")), "left").select(*columns, row, marks), "marked")

    def first_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, bs, out = [], [], []
            for k, (text, own) in enumerate(zip(batch.column(2).to_pylist(), _rows_of(batch.column(3), "lo", "hi"))):
                words = text.split()
                for b in sorted({b for lo, hi in own for b in range(max(lo - REACH, 0) // BLOCK, (min(hi + REACH, len(words)) - 1) // BLOCK + 1)}):
                    of.append(k)
                    bs.append(b)
                    out.append(" ".join(words[b * BLOCK:(b + 1) * BLOCK]))
            of = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(bs, pa.int32()), pa.array(out, pa.string())], ["sid", "srow", "b", "piece"])

    going, stays = F.filter(marks, lambda m: m["drop"]), F.filter(marks, lambda m: ~m["drop"])
    some = lambda a: F.coalesce(F.size(a) > 0, F.lit(False))
    first = marked.where(some(stays)).select(id_col, row, F.col(text_col).cast("string"), stays.alias(marks)).mapInArrow(first_places, f"sid {kind}, srow long, b int, piece string").dropDuplicates(["sid", "srow", "b"])
    block = lambda i: F.floor(i / BLOCK).cast("int")
    asked = runs.where("drop").select(F.col("id").alias("_id"), F.col("row").alias("_r"), F.col("sid").alias("_s"), F.col("srow").alias("_sr"), F.explode(F.sequence(block(F.greatest(F.col("lo") - F.col("shift") - REACH, F.lit(0))), block(F.col("hi") - F.col("shift") + (REACH - 1)))).alias("_b"))
    pieces = asked.join(first, F.col("_s").eqNullSafe(F.col("sid")) & (F.col("_sr") == F.col("srow")) & (F.col("_b") == F.col("b"))).groupBy("_id", "_r").agg(F.collect_set(F.struct("sid", "srow", "b", "piece")).alias(found_pieces))
    ready = marked.where(some(going)).join(pieces, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col(row) == F.col("_r")), "left")
    where, width = columns.index(text_col), len(columns)

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = batch.column(where).to_pylist(), []
            mine = zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), _rows_of(batch.column(width + 2), "lo", "hi", "shift", "sid", "srow"), _rows_of(batch.column(width + 3), "sid", "srow", "b", "piece"))
            for k, (i, r, own, got) in enumerate(mine):
                texts[k], n = _take_out(texts[k], own, got, (i, r))
                counts.append(n)
            arrays = [batch.column(c) if c != where else pa.array(texts, pa.string()) for c in range(width)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int32())], [*columns, removed])

    given = [F.col(c).cast("string") if c == text_col else F.col(c) for c in columns]
    schema = docs.select(*given).withColumn(removed, F.lit(0)).schema
    changed = ready.select(*given, F.col(id_col).alias("_own"), row, going.alias(marks), found_pieces).mapInArrow(without, schema)
    return marked.where(~some(going)).select(*given, F.lit(0).alias(removed)).unionByName(changed), removed
