"""Near-duplicate components of 64-bit SimHash fingerprints by deletion-variant signatures.

Three differing bits over two segments of 32 leave one segment with one differing bit at most. So each segment is indexed
32 times, with one bit left out each time: two fingerprints that agree on such a variant meet there, wherever in the
segment they differ. The join is one of equality on the variant; what meets is verified on all 64 bits.

Distinct fingerprints only are indexed, so exact copies cost nothing. A variant is read off the fingerprint, so that an
entry is eight bytes in the group of its variant and key range. Many fingerprints may share a variant: such keys are found
beforehand, from exact counts of the segments' values, and cut again: within a variant the other segment differs in three
bits at most, so one of its halves differs in one at most and is indexed with one bit left out likewise. Such an entry
leaves 18 bits open, so that no more than 2^18 fingerprints can ever share it. What meets under a key is joined as stars, not listed as pairs.

Defined cases: a null or wordless text has fingerprint zero and links like any other; a text of one or two words is one
shingle; repeated shingles count as often as they stand; equal texts, and rows that repeat an id, give a row each; a null id
is never the smallest unless its component has no other; a tie between set and unset bits is unset; further columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shards_for, space_words, stored
from .linked import stars

SEED, WIDTH, RADIUS = 42, 3, 3
GROUP_ENTRIES = 1_000_000       # of one variant, in one group
HOT_MEMBERS = 4096              # fingerprints of one key from which it is cut again
MOST_HOT_KEYS = 1_000_000       # told to the tasks; beyond, only keys of more members are cut again
_U = np.uint64
_BYTES = (np.arange(8, dtype=np.int64) * 256)[None, :]
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.float64)
#: Bits of the fingerprint that a variant keeps: a segment without one bit.
VARIANTS = np.array([(0xFFFFFFFF ^ (1 << i)) << (32 * s) for s in range(2) for i in range(32)], np.uint64)
#: Further bits of the other segment that a second variant keeps, by the first one's segment.
SECOND = [np.array([(0xFFFF ^ (1 << i)) << (32 * (1 - s) + 16 * h) for h in range(2) for i in range(16)], np.uint64) for s in range(2)]


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    words = space_words(text)
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    h = np.array([xxhash.xxh64_intdigest(g, seed) for g in grams], _U)
    by_byte = np.bincount((h.view(np.uint8).reshape(-1, 8) + _BYTES).ravel(), minlength=2048).reshape(8, 256)
    ones = by_byte.astype(np.float64) @ _BITS                   # of bit i of byte j; exact, far below 2^53
    return int.from_bytes(np.packbits(2 * ones > len(h), axis=1, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """``id, fp`` of every row, the fingerprint as a long of the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width, seed) for t in batch.column(1)], _U)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, fp long")


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number of each node's component."""
    lab = np.arange(n)
    while len(a):
        low = np.minimum(lab[a], lab[b])
        np.minimum.at(lab, lab[a], low)
        np.minimum.at(lab, lab[b], low)
        while not np.array_equal(up := lab[lab], lab):
            lab = up
        open_ = lab[a] != lab[b]
        a, b = a[open_], b[open_]
    return lab


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= RADIUS


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return first, np.diff(first, append=len(key))


def _within(fps: np.ndarray, block: int = 1024) -> np.ndarray:
    """Labels of the components of one key's fingerprints, compared in blocks; what one star joins needs no more."""
    lab = np.where(_near(fps, fps[0]), 0, np.arange(len(fps)))
    if not lab.any():
        return lab
    for i in range(0, len(fps), block):
        for j in range(i, len(fps), block):
            if (lab[i:i + block] == lab[i]).all() and (lab[j:j + block] == lab[i]).all():
                continue
            a, b = np.nonzero(_near(fps[i:i + block, None], fps[None, j:j + block]))
            a, b = a + i, b + j
            open_ = lab[a] != lab[b]
            lab = _labels(len(fps), np.concatenate((lab, a[open_])), np.concatenate((np.arange(len(fps)), b[open_])))
    return lab


def joined(fps: np.ndarray, mask: np.uint64, second: np.ndarray | None) -> np.ndarray:
    """Pairs that join what links among the fingerprints that agree on ``mask``: a forest, as rows of two."""
    order = np.argsort(fps & mask, kind="stable")
    fps = fps[order]
    first, sizes = _runs(fps & mask)
    pairs = []
    short = np.repeat(sizes, sizes) <= 64
    left = np.repeat(first + sizes, sizes) - np.arange(len(fps)) - 1       # members behind in the same run
    for step in range(1, 64):
        at = np.flatnonzero(short & (left >= step))
        if not len(at):
            break
        at = at[_near(fps[at], fps[at + step])]
        pairs.append(np.stack((at, at + step), 1))
    for s, n in zip(first[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
        part = fps[s:s + n]
        if n > HOT_MEMBERS and second is not None and not _near(part, part[0]).all():
            sub = np.concatenate([joined(part, mask | m, None) for m in second])
            up = np.argsort(part)
            pairs.append(up[np.searchsorted(part, sub, sorter=up)] + s)
        else:
            lab = _within(part)
            pairs.append(np.stack((np.arange(n), lab), 1) + s)
    if not pairs:
        return np.zeros((0, 2), _U)
    a, b = np.concatenate(pairs).T
    lab = _labels(len(fps), a, b)
    at = np.flatnonzero(lab != np.arange(len(fps)))
    return np.stack((fps[at], fps[lab[at]]), 1)


def _hot_keys(classes: DataFrame) -> tuple[list[np.ndarray], int]:
    """Per variant the keys that may hold more than a limit of fingerprints, and how many entries those can be. A key's members have one of two
    values of its segment, so one of these is held by half the limit."""
    values = classes.select(F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.shiftrightunsigned("fp", 32 * s).bitwiseAND(F.lit(0xFFFFFFFF)).alias("v")) for s in range(2)])).alias("x"))
    counts = values.groupBy("x.s", "x.v").agg(F.count("*").alias("n"))
    limit = HOT_MEMBERS
    heavy = stored(counts.where(F.col("n") > limit // 2), "heavy")
    while heavy.where(F.col("n") > limit // 2).count() * 32 > MOST_HOT_KEYS:
        limit *= 2
    keys, entries = [[] for _ in VARIANTS], 0
    for r in heavy.where(F.col("n") > limit // 2).collect():        # at most MOST_HOT_KEYS / 32
        entries += 32 * r.n
        for i in range(32):
            keys[32 * r.s + i].append((r.v << (32 * r.s)) & int(VARIANTS[32 * r.s + i]))
    return [np.unique(np.array(k, _U)) for k in keys], entries


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    return x ^ (x >> _U(29))


def links(classes: DataFrame, n: int) -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints that join all that link."""
    hot, entries = _hot_keys(classes)
    parts, parts_hot = shards_for(n, GROUP_ENTRIES), shards_for(entries, 4 * GROUP_ENTRIES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(fps: np.ndarray, mask: np.uint64, variant: int, second: int, parts: int):
            part = (_mix(fps & mask) % _U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            for chunk in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                if len(chunk):
                    out.append((variant, second, int(part[chunk[0]]), fps[chunk].tobytes()))

        def flush() -> pa.RecordBatch:
            fps = np.concatenate(held)
            for variant, mask in enumerate(VARIANTS):
                cut = np.isin(fps & mask, hot[variant]) if len(hot[variant]) else np.zeros(len(fps), bool)
                rows(fps[~cut], mask, variant, -1, parts)
                if cut.any():
                    for second, more in enumerate(SECOND[variant // 32]):
                        rows(fps[cut], mask | more, variant, second, parts_hot)
            columns = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["variant", "second", "part", "fps"])

        held, out, size = [], [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(_U))
            size += batch.num_rows
            if size >= 50_000:
                yield flush()
                held, out, size = [], [], 0
        if size:
            yield flush()

    def meet(group: pa.Table) -> pa.Table:
        variant, second = group.column("variant")[0].as_py(), group.column("second")[0].as_py()
        mask = VARIANTS[variant] | (SECOND[variant // 32][second] if second >= 0 else _U(0))
        fps = np.unique(np.frombuffer(b"".join(group.column("fps").to_pylist()), _U))
        found = joined(fps, mask, SECOND[variant // 32] if second < 0 else None)
        return pa.table({"a": np.ascontiguousarray(found[:, 0]).view(np.int64), "b": np.ascontiguousarray(found[:, 1]).view(np.int64)})

    dealt = classes.select("fp").mapInArrow(deal, "variant int, second int, part int, fps binary")
    return dealt.groupBy("variant", "second", "part").applyInArrow(meet, "a long, b long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """``id, fp, component_id`` of every row: the fingerprint and the smallest id among all that links reach."""
    signed = stored(fingerprints(docs, id_col, text_col, width, seed), "signed")
    classes = stored(signed.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    n = classes.count()
    comps = stars(stored(links(classes, n).distinct(), "links"))
    reached = classes.join(comps, F.col("fp") == F.col("high"), "left").select("fp", "least", F.coalesce("low", "fp").alias("comp"))
    least = reached.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = reached.join(least, "comp").select("fp", "component_id")
    return signed.join(named, "fp", "left").select("id", "fp", "component_id")
