"""The Jaccard join and the line dedup against brute force."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from courtlake.llm import jaccard, linededup
from courtlake.operators.components import components

from .conftest import ascii_lower


def _sets(pairs):
    out = []
    for i, t in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t))
        out.append((i, frozenset(zip(w, w[1:], w[2:], w[3:])) if len(w) >= 4 else frozenset([tuple(w)] if w else [])))
    return out


def _components(rows, percent=85):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    lists = defaultdict(list)
    for k, (_, s) in enumerate(rows):
        both = Counter(j for g in s for j in lists[g])
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(rows[j][1]) - n):
                root[find(k)] = find(j)
        for g in s:
            lists[g].append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(s), least.get(find(k))) for k, (i, s) in enumerate(rows)), len({find(k) for k in range(len(rows))})


@pytest.mark.parametrize("local_hot,block", [(64, 512), (3, 8)])
def test_components_equal_brute_force(docs, pairs, monkeypatch, local_hot, block):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard, "LOCAL_HOT", local_hot)
    got = jaccard.join(docs).collect()
    expect, parts = _components(_sets(pairs))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expect
    assert sum(r.is_first for r in got) == parts


def test_a_chain_of_near_copies_is_one_component(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(60):                                  # each differs from the one before in a word; ends share nothing much
        rows.append((k, " ".join(words)))
        words[(2 * k) % 120] = f"x{rng.random()}"
    rng.shuffle(rows)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expect, _ = _components(_sets(rows))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expect
    assert len({r.component_id for r in got}) < 60


def test_pigeonhole_holds_for_random_sets():
    rng, rule, linked = np.random.default_rng(5), jaccard.Rule(85), 0
    for _ in range(3000):
        n = int(rng.integers(1, 200))
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        y = np.concatenate((x[rng.random(n) > rng.choice([0, 0.03, 0.07])], rng.integers(0, 2**63, int(rng.integers(0, n // 12 + 1))).astype(np.uint64)))
        x, y = np.unique(x), np.unique(y)
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= 85 * (len(x) + len(y) - both):
            small, large = sorted((x, y), key=len)
            a, b = jaccard.entries(small, rule), jaccard.entries(large, rule)
            three, two = np.uint64(3), np.uint64(2)
            indexed = {int(k >> two) for k in a if int(k & three) & 1}
            linked += 1
            assert indexed & {int(k >> two) for k in b if int(k & three) & 2}, (len(small), len(large), both)
    assert linked > 500


def test_one_document_of_each_group_stays(docs, no_docs, pairs):
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    _, parts = _components(_sets(pairs))
    assert kept.count() == parts
    assert jaccard.keep_first(no_docs).count() == 0 and jaccard.join(no_docs).count() == 0


def test_components_of_a_graph(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1200)] + [(5, 5)]
    root = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.a: r.b for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if k != v}


def _dedup(rows):
    seen, out = set(), []
    key = lambda r: (r[0] is not None, r[0] or 0)
    for i, t in sorted(rows, key=key):
        parts, n = linededup.units(t or ""), 0
        assert "".join(parts) == (t or "")
        cut = list(parts)
        for a, b in linededup.chunks(parts):
            body = "".join(parts[a:b]).strip()
            if b - a >= 2 and sum(1 for p in parts[a:b] if p.strip()) >= 2 and len(body.split()) >= linededup.LEAST_WORDS:
                if body in seen:
                    cut[a:b] = [""] * (b - a)
                    n += 1
                seen.add(body)
        out.append((i, "".join(cut).rstrip("\n") if n else t, n))
    return out


def test_repeated_passages_go(docs, pairs):
    rows = [(i, t) for i, t in pairs if i not in (3, None)]              # one text per id: the order is plain
    cleaned, removed = linededup.dedup_lines(docs.where("doc_id is not null and doc_id <> 3"))
    assert removed == "n_removed_" and cleaned.columns[:-1] == docs.columns
    got = [(r.doc_id, r.text, r[removed]) for r in cleaned.collect()]
    assert Counter(got) == Counter(_dedup(rows))
    assert sum(n for *_, n in got) > 20


def test_repeated_rows_share_one_fate(spark, texts):
    base = texts[8]
    rows = [(1, base), (1, base), (2, base), (None, base), (None, None)]
    got = Counter((r.doc_id, r.text == base, r.n_removed > 0) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect())
    assert got == Counter({(1, False, True): 2, (2, False, True): 1, (None, True, False): 1, (None, False, False): 1})


def test_equal_hashes_of_unequal_chunks_remove_nothing(spark, texts, monkeypatch):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts[40:70]) if t], "doc_id long, text string")
    monkeypatch.setattr(linededup, "_hash", lambda body: len(body) % 3)
    got = linededup.dedup_lines(docs)[0].collect()
    assert {(r.doc_id, r.text) for r in got} == {(r.doc_id, r.text) for r in docs.collect()}


def test_shifted_passages_are_cut_alike(texts):
    base = linededup.units(texts[8])
    shifted = ["a new line that stands before all others\n", *base]
    bodies = lambda p: {"".join(p[a:b]) for a, b in linededup.chunks(p)}
    assert len(bodies(base) & bodies(shifted)) >= len(bodies(base)) - 2


def test_line_dedup_of_an_empty_table(no_docs):
    assert linededup.dedup_lines(no_docs)[0].count() == 0
