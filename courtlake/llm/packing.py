"""Packing of token pieces into sequences of a fixed size by a grouping genetic algorithm on islands.

Documents are tokenized, end with the separator id, and only longer ones are cut: the odd piece first, then full ones.
Full pieces are sequences of their own. The rest is dealt to shards of about ``SHARD`` pieces by a hash of a number that
every piece has of its own, so the shards are even whatever the documents are. Every shard is evolved on several
islands, each one row of a DataFrame: a child takes well-filled sequences whole from one parent, keeps those of the
other parent that share no piece with them, and puts the displaced pieces where they fit best. Between epochs the best
packing of each island moves to the next island of its shard. The best of a shard's islands is its packing.

Defined cases: a null text is empty and has the separator alone; rows that repeat an id are packed each on its own; a
null id is passed through; further columns are ignored.
"""
from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shards_for, stored

SHARD = 20_000
_INNER_SPACE = re.compile(r"\s (?:\s|$)")
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 3, 2, 5, 4


class _Tokens(dict):
    """Token ids, as bytes, of a space and a word. A space starts a new token of this vocabulary unless there is white
    space on both of its sides, so a text is the join of its words; a text with such a space is encoded whole."""

    def __init__(self, ranks_path: str | None, most: int = 300_000):
        import public_tokenizers
        import tiktoken

        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._most = most

    def bytes_of(self, text: str) -> bytes:
        return np.array(self._encode(text), "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self._most:
            self.clear()
        ids = self[word] = self.bytes_of(" " + word)
        return ids

    def text(self, text: str) -> bytes:
        if _INNER_SPACE.search(text):
            return self.bytes_of(text)
        first, *rest = text.split(" ")
        return self.bytes_of(first) + b"".join(map(self.__getitem__, rest))


class _Whole:
    """Token ids of texts that may hold added tokens of the vocabulary, such as <|endoftext|>: these have ids of their own,
    and what stands between them is encoded as text."""

    def __init__(self, tokens: _Tokens, added_path: str | None):
        import public_tokenizers

        with open(added_path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            self._ids = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in json.load(f)["added_tokens"]}
        self._text = tokens.text
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self._ids, key=len, reverse=True))) + ")").split if self._ids else lambda text: [text]

    def text(self, text: str) -> bytes:
        return b"".join(self._ids[part] if k % 2 else self._text(part) for k, part in enumerate(self._split(text)) if part)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, added_path: str | None = None, capacity: int = 1024, separator: int = 2, with_ids: bool = False) -> DataFrame:
    """Stored: one row per piece, numbered over all; ``ids`` only if asked for."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, uid = _Whole(_Tokens(ranks_path), added_path), TaskContext.get().partitionId() << 33
        end = np.array([separator], "<u4").tobytes()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part, at, no, begin, length, crc, ids = batch.slice(start, 1000), [], [], [], [], [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    own = tokens.text(text or "") + end
                    n = len(own) // 4
                    bounds = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for p, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        at.append(k)
                        no.append(p)
                        begin.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(own[4 * a:4 * b]))
                        if with_ids:
                            ids.append(np.frombuffer(own[4 * a:4 * b], "<i4"))
                m = len(at)
                arrays = [pa.array(np.arange(uid, uid + m)), part.column(0).take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), *(pa.array(x, pa.int64()) for x in (begin, length, crc))]
                uid += m
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, ["uid", "doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    schema = f"uid long, doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return stored(docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(cut, schema), "pieces")


def _best_fit(items: list[int], lens: list[int], room: list[int], bins: np.ndarray, capacity: int) -> None:
    """Puts each item into the bin with the least room that holds it, or into a new one; ``room`` and ``bins`` change."""
    at, mask = [[] for _ in range(capacity + 1)], 0
    for b, r in enumerate(room):
        if r:
            at[r].append(b)
            mask |= 1 << r
    for i in items:
        n = lens[i]
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = at[r].pop()
            if not at[r]:
                mask ^= 1 << r
        else:
            b, r = len(room), capacity
            room.append(capacity)
        bins[i] = b
        room[b] = r = r - n
        if r:
            at[r].append(b)
            mask |= 1 << r


def _fresh(order: np.ndarray, lens: np.ndarray, capacity: int) -> np.ndarray:
    bins = np.zeros(len(lens), np.int32)
    _best_fit(order.tolist(), lens.tolist(), [], bins, capacity)
    return bins


def _worth(bins: np.ndarray, lens: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller full ones: smaller is better."""
    fill = np.bincount(bins, lens)
    return len(fill), -float(np.mean((fill / capacity) ** 2)) if len(fill) else 0.0


def _child(a: np.ndarray, b: np.ndarray, lens: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Well-filled bins of ``a`` whole, the bins of ``b`` that share no piece with them, the rest by best fit."""
    fill = np.bincount(a, lens)
    inject = (fill >= np.quantile(fill, 0.5)) & (rng.random(len(fill)) < 0.7)
    given = inject[a]
    clash = np.zeros(int(b.max()) + 1, bool)
    clash[b[given]] = True
    stay = ~given & ~clash[b]
    out = np.full(len(lens), -1, np.int64)
    out[given] = a[given]
    out[stay] = b[stay] + len(fill)
    placed = out >= 0
    _, out[placed] = np.unique(out[placed], return_inverse=True)
    room = (capacity - np.bincount(out[placed], lens[placed])).astype(np.int64).tolist() if placed.any() else []
    left = np.flatnonzero(~placed)
    out = out.astype(np.int32)
    _best_fit(left[np.argsort(-lens[left], kind="stable")].tolist(), lens.tolist(), room, out, capacity)
    return out


def _evolve(lens: np.ndarray, packings: list[np.ndarray], seed: int, capacity: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    if not packings:
        packings.append(_fresh(np.argsort(-lens, kind="stable"), lens, capacity))
        while len(packings) < POPULATION:      # nearly sorted, each with other neighbours
            packings.append(_fresh(np.argsort(-lens * rng.uniform(0.8, 1.0, len(lens)), kind="stable"), lens, capacity))
    ranked = sorted(((_worth(p, lens, capacity), k, p) for k, p in enumerate(packings)), key=lambda x: x[:2])
    least = -(-int(lens.sum()) // capacity)
    for g in range(GENERATIONS):
        if ranked[0][0][0] <= least:            # no packing has fewer
            break
        x, y = rng.choice(len(ranked), 2, replace=False)
        child = _child(ranked[min(x, y)][2], ranked[max(x, y)][2], lens, capacity, rng)
        ranked = sorted([*ranked, (_worth(child, lens, capacity), len(packings) + g, child)], key=lambda r: r[:2])[:POPULATION]
    return [r[2] for r in ranked]


def pack(cut: DataFrame, capacity: int = 1024, shard: int = SHARD) -> DataFrame:
    """The rows of ``pieces`` with ``sequence_id`` and ``offset``."""
    small = cut.where(F.col("length") < capacity)
    shards = shards_for(small.count(), shard)
    dealt = small.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int"))

    def gather(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("uid").to_numpy())
        lens = group.column("length").to_numpy()[order].astype(np.int32).tobytes()
        k = group.column("shard")[0].as_py()
        return pa.table({"shard": pa.array([k] * ISLANDS, pa.int32()), "island": pa.array(range(ISLANDS), pa.int32()), "lens": pa.array([lens] * ISLANDS, pa.binary()), "packings": pa.array([[]] * ISLANDS, pa.list_(pa.binary())), "bins": pa.array([0] * ISLANDS, pa.int32()), "cost": pa.array([0.0] * ISLANDS)})

    schema = "shard int, island int, lens binary, packings array<binary>, bins int, cost double"
    state = dealt.select("shard", "uid", "length").groupBy("shard").applyInArrow(gather, schema)

    def evolving(epoch: int):
        def evolve(group: pa.Table) -> pa.Table:
            row = group.to_pylist()[0]
            lens = np.frombuffer(row["lens"], np.int32).astype(np.int64)
            best = _evolve(lens, [np.frombuffer(p, np.int32) for p in row["packings"]], 1_000_003 * row["shard"] + 101 * row["island"] + epoch, capacity)
            bins, cost = _worth(best[0], lens, capacity)
            return pa.table({"shard": pa.array([row["shard"]], pa.int32()), "island": pa.array([row["island"]], pa.int32()), "lens": pa.array([row["lens"]], pa.binary()), "packings": pa.array([[p.tobytes() for p in best]], pa.list_(pa.binary())), "bins": pa.array([bins], pa.int32()), "cost": pa.array([cost])})

        return evolve

    for epoch in range(EPOCHS):
        state = stored(state.groupBy("shard", "island").applyInArrow(evolving(epoch), schema), "islands")
        if epoch < EPOCHS - 1:                   # each island's best packing moves on to the next island of its shard
            guest = state.select(F.col("shard").alias("s"), F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("i"), F.slice("packings", 1, 1).alias("guest"))
            state = state.join(guest, (F.col("shard") == F.col("s")) & (F.col("island") == F.col("i"))).select("shard", "island", "lens", F.concat("packings", "guest").alias("packings"), "bins", "cost")
    best = state.groupBy("shard").agg(F.min(F.struct("bins", "cost", "island", F.element_at("packings", 1).alias("packing"))).alias("best")).select("shard", "best.packing")

    def place(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pa.array(np.argsort(left.column("uid").to_numpy())))
        bins, lens = np.frombuffer(right.column("packing")[0].as_py(), np.int32).astype(np.int64), left.column("length").to_numpy()
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lens[order]) - lens[order]
        first = np.concatenate(([True], np.diff(bins[order]) != 0))
        offsets = np.empty(len(lens), np.int64)
        offsets[order] = before - np.repeat(before[first], np.diff(np.flatnonzero(first), append=len(lens)))
        return left.drop_columns(["shard"]).append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    rows = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields) + ", sequence_id long, offset long"
    packed = dealt.groupBy("shard").cogroup(best.groupBy("shard")).applyInArrow(place, rows)
    full = cut.where(F.col("length") == capacity).select("*", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full).drop("uid")
