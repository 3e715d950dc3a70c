"""Cross-entropy difference of a target and a background bigram model.

Both models count the whole of what they stand for: the background every document, the target those labelled good. They
share one vocabulary (words that stand in the corpus twice or more; others cost both models the same), one order and
one smoothing, and background counts are scaled to the target's mass, so that the smoothing weighs alike. Every token
is left out of the counts that score it.

Documents are dealt to blocks of a bounded number of words. A block asks for the corpus counts of its own distinct
words and bigrams: the questions, with the block's own counts, meet in buckets of hashed keys, where they are summed and
answered, unless nobody else has it. A frequent bigram comes once from each block, not once from each place, and neither the models nor the corpus
pass through one task or the driver.

Defined cases: a null or wordless text has no words and null losses; a null label counts as no label, an id is a target if
any of its labels is; without a target document both models are the same and all scores are 0; rows that repeat an
id are scored each on its own text; further columns are ignored.
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

BLOCK_WORDS = 1_000_000
BUCKET_KEYS = 1_000_000
NOMINAL_WORDS = 1 << 20      # size of the vocabulary in the last smoothing step
WORD_MASS, HISTORY_MASS = 1000.0, 5.0
BROADCAST_TARGETS = 1_000_000        # ids; more are joined by a shuffle
_U = np.uint64
_START, _A, _B, _ONE = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _A
    x = (x ^ (x >> _U(29))) * _B
    return x ^ (x >> _U(32))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _blocks(docs: DataFrame, id_col: str, text_col: str, target: str) -> DataFrame:
    """Stored: one row per block with its documents, its distinct words and each token's place among them."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"block long, ids array<{kind}>, lengths binary, targets binary, words binary, tokens binary, n long, n_target long"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, parts, flags, held, n, idtype = _Hashes(), [], [], [], 0, TaskContext.get().partitionId() << 33, None

        def flush() -> pa.RecordBatch:
            words, tokens, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")                # frequent words get small numbers
            rank = np.empty(len(words), np.int32)
            rank[order] = np.arange(len(words), dtype=np.int32)
            words, tokens = words[order], rank[tokens]
            lengths, good = np.array([len(p) for p in parts], np.int32), np.array(flags, bool)
            values = [n, ids, lengths.tobytes(), good.tobytes(), words.tobytes(), _planes(tokens.astype(np.int32)), int(lengths.sum()), int(lengths[good].sum())]
            types = [pa.int64(), pa.list_(idtype), *[pa.binary()] * 4, pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], ["block", "ids", "lengths", "targets", "words", "tokens", "n", "n_target"])

        for batch in batches:
            idtype = batch.schema.field(0).type
            for i, text, good in zip(*(batch.column(c).to_pylist() for c in range(3))):
                words = alnum_words(text)
                ids.append(i)
                flags.append(good)
                parts.append(np.fromiter(map(hashes.__getitem__, words), _U, len(words)))
                held += len(words)
                if held >= BLOCK_WORDS:
                    yield flush()
                    ids, parts, flags, held, n = [], [], [], 0, n + 1
        if ids:
            yield flush()

    return stored(docs.select(F.col(id_col), F.col(text_col).cast("string"), target).mapInArrow(build, schema), "blocks")


def _planes(numbers: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones, and so on: what is alike then stands together and compresses."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T).tobytes()


def _from_planes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.concatenate([_from_planes(x, kind) for x in column.to_pylist()])


class _Block:
    """Keys of a block's distinct words (the start of a text is the last) and bigrams, and its own counts of them."""

    def __init__(self, lengths: bytes, targets: bytes, words: bytes, tokens: bytes):
        self.lengths, good = np.frombuffer(lengths, np.int32).astype(np.int64), np.frombuffer(targets, bool)
        self.tokens = _from_planes(tokens, np.int32)
        words = np.append(np.frombuffer(words, _U), _START)
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        full = self.lengths[self.lengths > 0]
        self.before[np.cumsum(full) - full] = len(words) - 1
        self.good = np.repeat(good, self.lengths)
        pairs, self.pair = np.unique(_mix(words[self.before] * _A + words[self.tokens] * _B), return_inverse=True)
        keys = np.concatenate((_mix(words ^ _ONE), pairs))
        self.n_words = len(words)
        count = lambda x, w, k: np.bincount(x, w, k)
        start = [float(len(full)), float((good & (self.lengths > 0)).sum())]
        every = [np.append(count(self.tokens, w, len(words) - 1), s) for w, s in zip((None, self.good), start)]
        both = [np.concatenate((e, count(self.pair, w, len(pairs)))) for e, w in zip(every, (None, self.good))]
        self.order = np.argsort(keys)
        self.keys, self.counts = keys[self.order], [b[self.order].astype(np.uint32) for b in both]


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score``: mean loss per token in nats; a low score is near the target."""
    kind = docs.schema[id_col].dataType.simpleString()
    targets = stored(labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_target")).distinct(), "targets")
    side = F.broadcast(targets) if targets.count() <= BROADCAST_TARGETS else targets
    flagged = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(side, F.col("doc_id") == F.col("_target"), "left").select("doc_id", "text", F.col("_target").isNotNull().alias("good"))
    blocks = _blocks(flagged, "doc_id", "text", "good")
    total = blocks.agg(F.sum("n").alias("n"), F.sum("n_target").alias("t")).first()
    n_back, n_target = total.n or 0, total.t or 0
    buckets = shards_for(n_back, BUCKET_KEYS)
    scale = n_target / n_back if n_target else 1.0

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *own in zip(*(batch.column(c).to_pylist() for c in range(5))):
                b = _Block(*own)
                at = ((b.keys >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
                first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                cuts = [slice(s, e) for s, e in zip(first, [*first[1:], len(at)])]
                for part in (cuts[i:i + 200] for i in range(0, len(cuts), 200)):
                    yield pa.RecordBatch.from_arrays([pa.array([int(at[c.start]) for c in part], pa.int32()), pa.array([block] * len(part), pa.int64()), pa.array([_planes(np.diff(b.keys[c], prepend=_U(0))) for c in part], pa.binary()), *(pa.array([_planes(x[c]) for c in part], pa.binary()) for x in b.counts)], ["bucket", "block", "keys", "back", "target"])

    def answer(group: pa.Table) -> pa.Table:
        texts = group.column("keys").to_pylist()
        ends = np.cumsum([len(t) // 8 for t in texts])
        _, same = np.unique(np.concatenate([np.cumsum(_from_planes(t, _U), dtype=_U) for t in texts]), return_inverse=True)      # sent as steps
        out = {"block": group.column("block"), "bucket": group.column("bucket")}
        sums = [np.bincount(same, _joined(group.column(c), np.uint32))[same].astype(np.float32) for c in ("back", "target")]
        more = [x >= 2 for x in np.split(sums[0], ends[:-1])]        # what stands once in the corpus is known to who asks
        out["more"] = pa.array([np.packbits(m).tobytes() for m in more], pa.binary())
        out["n"] = pa.array([len(m) for m in more], pa.int32())
        for c, x in zip(("back", "target"), sums):
            out[c] = pa.array([_planes(y[m]) for m, y in zip(more, np.split(x, ends[:-1]))], pa.binary())
        return pa.table(out)

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("ids").combine_chunks().values
        b = _Block(*(left.column(c)[0].as_py() for c in ("lengths", "targets", "words", "tokens")))
        right = right.sort_by("bucket")
        more = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(right.column("more").to_pylist(), right.column("n").to_pylist())]).astype(bool)
        losses = []
        known = None
        for c, asked_with, factor, mass, own in (("back", b.counts[0], scale, n_back * scale, np.ones(len(b.tokens))), ("target", b.counts[1], 1.0, float(n_target), b.good.astype(float))):
            answered, counts = asked_with.astype(float), np.empty(len(b.keys))
            answered[more] = _joined(right.column(c), np.float32)
            counts[b.order] = answered
            word, history, pair = counts[b.tokens], counts[b.before], counts[b.n_words:][b.pair]
            if known is None:
                known = word >= 2
            if c == "target" and not n_target:
                losses.append(losses[0])
                continue
            p = ((word - own) * factor + WORD_MASS / NOMINAL_WORDS) / (mass - own * factor + WORD_MASS)
            p = ((pair - own) * factor + HISTORY_MASS * p) / ((history - own) * factor + HISTORY_MASS)
            losses.append(np.where(known, -np.log(np.maximum(p, 1e-300)), np.log(NOMINAL_WORDS)))
        full = b.lengths > 0
        starts = np.cumsum(b.lengths[full]) - b.lengths[full]
        means = [pa.array(np.repeat(np.nan, len(b.lengths)), pa.float64()) for _ in losses]
        for k, x in enumerate(losses):
            mean = np.full(len(b.lengths), np.nan)
            if len(starts):
                mean[full] = np.add.reduceat(x, starts) / b.lengths[full]
            means[k] = pa.array(mean, pa.float64(), from_pandas=True)
        return pa.table({"doc_id": ids, "n_tokens": pa.array(b.lengths), "background_loss": means[0], "target_loss": means[1]})

    asked = blocks.select("block", "lengths", "targets", "words", "tokens").mapInArrow(ask, "bucket int, block long, keys binary, back binary, target binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "block long, bucket int, more binary, n int, back binary, target binary")
    scored = blocks.drop("n", "n_target").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(weigh, f"doc_id {kind}, n_tokens long, background_loss double, target_loss double")
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))
