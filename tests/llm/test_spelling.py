"""Spelling variants against every possible edit of every word, and the parts of the search."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from courtlake.llm import queries, spelling

RUN, LOWER = re.compile("[A-Za-zÀ-ÿ]+"), {c: c + 32 for c in range(65, 91)}


def brute(pairs, shortest=5, least=3):
    c = Counter()
    for i, text in pairs:
        for x in RUN.findall(text or ""):
            x = x.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{x}".encode())
            x = x[:h % len(x)] + x[h % len(x) + 1:] if h % 97 == 0 else x
            if len(x) >= shortest:
                c[x] += 1
    words = {w: n for w, n in c.items() if n >= least}
    letters = {ch for w in words for ch in w}
    out, form = {}, {}
    for w, n in words.items():
        near = {w[:i] + ch + w[i + k:] for i in range(len(w) + 1) for ch in letters for k in (0, 1)} | {w[:i] + w[i + 1:] for i in range(len(w))}
        near = [x for x in near - {w} if x in words]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = (n, len(near))
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, *out[w], words[form[w]] if form[w] else None)
    return out


def found(df):
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.fixture(scope="module")
def corpus(spark):
    """Words a few edits apart, of three alphabets, with counts from one to hundreds."""
    rng = random.Random(3)
    stems = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["straße", "élèves", "œuvre", "naïveté", "façades", "x" * 300, "a×b÷cde"]
    texts = []
    for i in range(300):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = list(rng.choice(stems[:5] if rng.random() < 0.5 else stems))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w[k:k + rng.choice([0, 1])] = rng.choice(["", "e", "s", "É", "Z"])
                w = w or ["a"]
            words.append("".join(w))
        texts.append(rng.choice([" ", "-", "中", "\n"]).join(words))
    texts += [" ".join(["chain" + "abcdef"[:k]] * 3 ** k) for k in range(1, 6)]         # each the form of the one before
    return [*enumerate(texts), (None, None), (5, ""), (5, "straße STRASSE straße"), (None, "élèves élèves élèves ÉLÈVES")]


def test_equals_all_edits(spark, corpus, docs, pairs):
    frame = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in corpus], "doc_id long, text string, word int, root string, n int, size int").repartition(7)
    got, want = found(spelling.group_variants(frame)), brute(corpus)
    assert got == want and sum(1 for x in want.values() if x[0]) > 100 and any(x[0] != x[1] for x in want.values() if x[0])
    assert found(spelling.group_variants(docs, shortest=2, least=2)) == brute(pairs, 2, 2)


def test_leaves_and_copies_change_nothing(spark, corpus, monkeypatch):
    frame = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(spelling, "LEAF_WORDS", 20)
    monkeypatch.setattr(spelling, "SAMPLE", 2)
    monkeypatch.setattr(spelling, "LEAF_QUESTIONS", 7)
    words = spelling.stored(spelling.vocabulary(frame), "words")
    trees = spelling._upper_trees(words)
    assert max(int((t.letter < 0).sum()) for t, _ in trees.values()) >= 4 and max(c for _, c in trees.values()) >= 2
    assert found(spelling.group_variants(frame)) == brute(corpus)


def test_tree_reaches_all_within_one_step():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 3, (700, spelling._DIMS)) * (np.arange(spelling._DIMS) < 6)
    tree = spelling.grow(counts.astype(np.int32), 8)
    assert len(tree.start) > 40
    q, leaf, _ = tree.search(counts, np.zeros(700))
    reached = {(a, p) for a, b in zip(q.tolist(), leaf.tolist()) for p in tree.order[tree.start[b]:tree.start[b + 1]].tolist()}
    for a in range(0, 700, 7):
        d = counts - counts[a]
        near = np.flatnonzero((np.maximum(d, 0).sum(1) <= 1) & (np.maximum(-d, 0).sum(1) <= 1))
        assert all((a, p) in reached for p in near.tolist())
    assert len(reached) < 0.5 * 700 * 700


def test_no_words(spark, no_docs):
    assert found(spelling.group_variants(no_docs)) == {}
    assert found(spelling.group_variants(spark.createDataFrame([(1, None), (2, "ab 12")], "doc_id long, text string"))) == {}


def test_query(spark, sf_dir):
    got = queries.op12(spark, sf_dir)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert found(got) == brute([tuple(r) for r in rows])
