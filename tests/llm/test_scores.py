"""Quality rules, classifier, language models, packing, tool calls and the pipeline."""
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from courtlake.llm import classifier, crossentropy, packing, quality, queries, toolcalls
from courtlake.llm.common import alnum_words

WORD = r"[^\x20\x09-\x0D]+"


def _counts(text):
    text = text or ""
    words, places, covered, seen, dup = re.findall(WORD, text), defaultdict(list), set(), set(), 0
    for i in range(len(words) - 7):
        places[tuple(words[i:i + 8])].append(i)
    for p in places.values():
        if len(p) > 1:
            covered.update(i + k for i in p for k in range(8))
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality_counts(docs, pairs, no_docs):
    judged, name = quality.judge(docs)
    assert name == "quality_" and judged.columns[:-1] == docs.columns
    rows = judged.collect()
    got = Counter((r.doc_id, *(r[name][f] for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))) for r in rows)
    assert got == Counter((i, *_counts(t)) for i, t in pairs)
    assert all(not (r[name].kept and r[name].base_failed) for r in rows)
    assert quality.keep_good(docs).columns == docs.columns and quality.keep_good(no_docs).count() == 0


def test_a_failing_host_is_strict_ground(spark):
    good, odd = " ".join(f"word{k}" for k in range(40)), " ".join(f"a{k} | | | # # #" for k in range(30))
    rows = [(k, odd if k % 10 else good, "bad.example") for k in range(300)] + [(1000 + k, good if k % 50 else odd, f"h{k % 6}.example") for k in range(600)]
    judged, name = quality.judge(spark.createDataFrame(rows, "doc_id int, text string, source string"))
    kept = {r.doc_id: r[name].kept for r in judged.collect()}
    assert [kept[k] for k in range(300)] == [k % 10 == 0 for k in range(300)]
    assert all(kept[1000 + k] for k in range(600))


def test_classifier_on_held_out_documents(spark):
    rng, common = random.Random(2), [f"w{k}" for k in "abcdefghijklmnop"]
    rows, labels = [], []
    for k in range(1500):
        toxic, bad = k % 7 == 0, k % 5 == 0
        words = [rng.choice(common) + rng.choice("xyz") for _ in range(30)] + ["vile"] * toxic
        rows.append((k, " ".join(w.upper() + "!!" if bad else w for w in words), f"h{k % 4}", "p", 1.0))
        if k < 900:
            labels.append((k, None if k % 50 == 1 else int(not bad), int(toxic), "extra"))
    rows += [(9000, None, None, None, 0.0), (9001, "", "h1", "p", 0.0), (9001, "vile " + "word " * 20, "h1", "p", 0.0)]
    labels += [(None, 0, 1, "x"), (777777, 0, 1, "x")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, toxic double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = classifier.judge(docs, known).collect()
    assert len(got) == len(rows)
    held = [r for r in got if 900 <= r.doc_id < 1500]
    assert np.mean([r.toxic == (r.doc_id % 7 == 0) for r in held]) > 0.97
    assert np.mean([r.kept == (r.doc_id % 7 != 0 and r.doc_id % 5 != 0) for r in held]) > 0.97
    none = classifier.judge(docs, known.limit(0)).collect()
    assert len(none) == len(rows) and all(r.kept and not r.toxic for r in none)
    assert classifier.judge(docs.limit(0), known).count() == 0


def test_sparse_sites_are_shrunk(spark):
    rows = [(k, "fine words only", "big", "p") for k in range(500)] + [(1000 + k, "vile", "worst", "p") for k in range(200)] + [(5000, "fine words only", "tiny", "p")]
    labels = [(k, 1, 0) for k in range(300)] + [(1000 + k, 1, 1) for k in range(100)]
    got = {r.doc_id: r for r in classifier.judge(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got[0].p_toxic < got[5000].p_toxic < 0.5 < got[1000].p_toxic


def test_losses_equal_brute_force(docs, pairs, spark, no_docs):
    labels = spark.createDataFrame([(k, 1 if k % 2 else 0, 0, "x") for k in range(0, 100)] + [(9, 1, 0, "x"), (None, 1, 0, "x"), (11, 1, None, "x")], "doc_id long, quality int, toxic int, text string")
    good = {k for k in range(100) if k % 2}
    words, follow, mass = [Counter(), Counter()], [Counter(), Counter()], [0, 0]
    texts = [(i, alnum_words(t)) for i, t in pairs]
    for i, w in texts:
        for m in (0, 1):
            if w and (not m or i in good):
                words[m].update([b"<s>", *w])
                follow[m].update(zip([b"<s>", *w], w))
                mass[m] += len(w)
    scale, expect = mass[1] / mass[0], []
    for i, w in texts:
        loss = [0.0, 0.0]
        for h, x in zip([b"<s>", *w], w):
            for m, f in ((0, scale), (1, 1.0)):
                own = (not m or i in good) * f
                p = (words[m][x] * f - own + crossentropy.WORD_MASS / crossentropy.NOMINAL_WORDS) / (mass[m] * f - own + crossentropy.WORD_MASS)
                p = (follow[m][h, x] * f - own + crossentropy.HISTORY_MASS * p) / (words[m][h] * f - own + crossentropy.HISTORY_MASS)
                loss[m] -= math.log(p) if words[0][x] >= 2 else -math.log(crossentropy.NOMINAL_WORDS)
        expect.append((-1 if i is None else i, len(w), *(x / len(w) if w else -1.0 for x in loss)))
    for block in (1_500_000, 400):
        crossentropy_block, crossentropy.BLOCK_WORDS = crossentropy.BLOCK_WORDS, block
        try:
            got = [(-1 if r.doc_id is None else r.doc_id, r.n_tokens, *(-1.0 if x is None else x for x in (r.background_loss, r.target_loss))) for r in crossentropy.score(docs, labels).collect()]
        finally:
            crossentropy.BLOCK_WORDS = crossentropy_block
        assert np.allclose(np.array(sorted(got)), np.array(sorted(expect)), atol=1e-4)
    assert all(abs(r.score or 0) < 1e-12 for r in crossentropy.score(docs, labels.limit(0)).collect())
    assert crossentropy.score(no_docs, labels).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizer(tokenizer):
    tokens, rng = packing._Tokens(None, most=50), random.Random(4)
    parts = [" ", "  ", "   ", "\n", "\t", "\r", "\u00a0", "\u2003", "a", "é", "'s", "12", ".", ",", "The", "'", "中", "😀", "<|endoftext|>"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert np.frombuffer(tokens.text(text), "<u4").tolist() == tokenizer(text), text


def test_packing(docs, pairs, tokenizer, no_docs):
    expect = Counter()
    for i, t in pairs:
        ids = [*tokenizer(t), 2]
        bounds = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        expect.update((i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b])) for p, (a, b) in enumerate(zip(bounds, bounds[1:])))
    cut = packing.pieces(docs, with_ids=True)
    for shard in (packing.SHARD, 25):
        rows = packing.pack(cut, shard=shard).collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in rows) == expect
        bins = defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for own in bins.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 1024
        if shard == packing.SHARD:
            assert len(bins) <= math.ceil(sum(r.length for r in rows) / 1024) + 2
    assert packing.pack(packing.pieces(no_docs)).count() == 0


def test_children_are_whole_packings():
    rng = np.random.default_rng(1)
    lens = rng.integers(1, 1024, 3000)
    a, b = (packing._fresh(order, lens, 1024) for order in (np.argsort(-lens, kind="stable"), rng.permutation(3000)))
    for _ in range(5):
        child = packing._child(a, b, lens, 1024, rng)
        assert len(child) == 3000 and child.min() == 0 and np.bincount(child, lens).max() <= 1024 and np.bincount(child).min() > 0
    best = packing._evolve(lens, [], 7, 1024)
    assert packing._worth(best[0], lens, 1024) <= packing._worth(a, lens, 1024)


SCHEMAS = {"add": {"a": ("BIGINT", True), "b": ("BIGINT", False)}, "say": {"text": ("STRING", True)}}


def _link(spark, calls, results):
    c = spark.createDataFrame(calls, "conv long, call_id string, position long, name string, arguments string, needs array<string>, level int, status string")
    r = spark.createDataFrame(results, "conv long, call_id string, position long, content string, call string")
    return toolcalls.link(c, r, SCHEMAS).collect()


def test_tool_calls(spark):
    calls = [
        (1, "a", 1, "add", '{"b": 2,  "a":1}', [], 9, "x"), (1, "b", 3, "add", '{"a":"x","c":1}', ["a"], 9, "x"), (1, "c", 5, "say", "{", [], 9, "x"), (1, "d", 7, "say", '{"text":"é"}', ["e"], 9, "x"), (1, "e", 9, "say", '{"text":"t"}', [], 9, "x"),
        (1, "f", 11, "say", '{"text":"t"}', ["d", "a"], 9, "x"), (1, "g", 13, "say", '{"text":"t"}', ["nowhere"], 9, "x"), (2, "h", 1, "say", '{"text":"t"}', ["i"], 9, "x"), (2, "i", 2, "say", '{"text":"t"}', ["h"], 9, "x"), (2, "j", 3, "say", '{"text":"t"}', ["i"], 9, "x"), (2, "s", 4, "say", '{"text":"t"}', ["s"], 9, "x"),
        (3, "a", 1, "fly", "{}", None, 9, "x"), (3, "k", 2, "say", None, [], 9, "x"), (3, None, 3, "say", '{"text":"t"}', [], 9, "x"), (None, "a", 1, "say", '{"text":"null"}', [], 9, "x"), (4, "r", 1, "say", '{"text":"one"}', [], 9, "x"), (4, "r", 1, "say", '{"text":"one"}', [], 9, "x"),
    ]
    results = [(1, k, 2, f"result {k}", "y") for k in "abcdefg"] + [(2, k, 9, "r", "y") for k in "hijs"] + [(3, "a", 5, "r", "y"), (3, "zz", 5, "lost", "y"), (3, None, 6, "none", "y"), (None, "a", 2, None, "y"), (4, "r", 3, "r", "y")]
    got = {(r.conv, r.call_id, r.position): r for r in _link(spark, calls, results)}
    status = {k: r.status for k, r in got.items()}
    assert status == {
        (1, "a", 1): "ok", (1, "b", 3): "invalid arguments", (1, "c", 5): "invalid arguments", (1, "d", 7): "ok", (1, "e", 9): "ok", (1, "f", 11): "ok", (1, "g", 13): "unknown need", (2, "h", 1): "cycle", (2, "i", 2): "cycle", (2, "j", 3): "cycle", (2, "s", 4): "cycle",
        (3, "a", 1): "invalid arguments", (3, "k", 2): "invalid arguments", (3, None, 3): "no id", (None, "a", 1): "ok", (4, "r", 1): "repeated id", (3, "zz", 5): "orphan result", (3, None, 6): "no id"}
    assert got[1, "b", 3].problems == "a is no bigint; unknown c"
    order = sorted((r for r in got.values() if r.conv == 1), key=lambda r: (r.level, r.position))
    names = [r.call_id for r in order]
    assert names.index("e") < names.index("d") < names.index("f") and names.index("a") < names.index("b")
    assert got[1, "a", 1].json == '{"arguments":{"a":1,"b":2},"id":"a","name":"add","needs":[],"result":"result a","status":"ok"}'
    assert json.loads(got[1, "d", 7].json)["arguments"] == {"text": "é"}
    assert _link(spark, [], []) == []


def test_pipeline_and_registered_queries(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, n = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns, name
        kept = corpus_pipeline.stored(kept, name)
        assert 0.7 * n < kept.count() <= n, name
        n = kept.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))


def test_the_pipeline_keeps_the_tables_of_one_stage(spark, sf_dir, tmp_path, monkeypatch):
    import corpus_pipeline
    from courtlake.llm import common

    monkeypatch.setattr(common, "scratch_dir", lambda spark, name: f"{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}")
    rows = corpus_pipeline.run(spark, sf_dir)
    names = {p.name.split("-")[0] for p in tmp_path.iterdir()}
    assert "decontamination" in names and not names & {"quality_rules", "line_dedup", "near_duplicates", "chunks", "marked", "signed"}
    assert rows.count() > 0


def test_every_stage_takes_odd_rows(docs):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(docs.sparkSession, docs, "odd")
        assert out.columns == docs.columns and out.count() <= docs.count(), name


def test_every_stage_takes_an_empty_table(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
