"""SimHash components against all pairs of fingerprints."""
import random

import numpy as np
import pytest
import xxhash

from courtlake.llm import linked, queries, simhash

from .conftest import ascii_lower


def brute_fingerprint(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", ascii_lower(text)) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    """Labels of all fingerprints by comparing all pairs of distinct ones."""
    u, inv = np.unique(np.array(fps, np.uint64), return_inverse=True)
    a, b = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 3)
    root = list(range(len(u)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return [find(x) for x in inv.tolist()]


def check(rows, want_fp=None):
    fps = [r.fp % 2**64 for r in rows]
    lab = components(fps)
    least = {}
    for k, r in zip(lab, rows):
        least[k] = r.id if least.get(k) is None else least[k] if r.id is None else min(least[k], r.id)
    assert [r.component_id for r in rows] == [least[k] for k in lab]
    return lab


def test_texts(docs, pairs):
    rows = simhash.join(docs).collect()
    assert sorted(((r.id, r.fp % 2**64) for r in rows), key=str) == sorted(((i, brute_fingerprint(t)) for i, t in pairs), key=str)
    check(rows)


def _clusters():
    """Fingerprints around centres, up to a dozen bits away, in chains and in dense balls."""
    rng = random.Random(11)
    out = [0, 7, 1 << 63, (1 << 64) - 1]
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 40)):
            out.append(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    ball = rng.getrandbits(64)
    for _ in range(3000):
        x = ball
        for _ in range(rng.randint(0, 14)):
            x ^= 1 << rng.choice([*range(20), 40])      # one segment stays as it is but for a bit: a hot key
        out.append(x)
    return out


@pytest.mark.parametrize("hot,most,group", [(4096, 1_000_000, 1_000_000), (128, 1_000_000, 500), (128, 64, 1_000_000), (256, 0, 300)])
def test_links_join_what_all_pairs_join(spark, monkeypatch, hot, most, group):
    if most == 0:
        most = 32
    for name, value in (("HOT_MEMBERS", hot), ("MOST_HOT_KEYS", most), ("GROUP_ENTRIES", group)):
        monkeypatch.setattr(simhash, name, value)
    fps = sorted(set(_clusters()))
    frame = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long").repartition(4)
    links = simhash.links(frame, len(fps)).distinct()
    stars = {r.high % 2**64: r.low % 2**64 for r in linked.stars(links).collect()}
    lab, mine = components(fps), {}
    for f, k in zip(fps, lab):
        mine.setdefault(k, set()).add(stars.get(f, f))
    assert all(len(s) == 1 for s in mine.values()) and len(set().union(*mine.values())) == len(mine)


def test_a_second_variant_holds_few():
    for variant, mask in enumerate(simhash.VARIANTS):
        for more in simhash.SECOND[variant // 32]:
            assert bin(int(mask | more)).count("1") == 46 and int(mask) & int(more) == 0


def test_random_pairs_meet():
    """Whatever the three bits are, some variant and then some second variant keep none of them."""
    rng = random.Random(2)
    for _ in range(2000):
        bits = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        firsts = [v for v, m in enumerate(simhash.VARIANTS) if not bits & int(m)]
        assert firsts and all(any(not bits & int(more) for more in simhash.SECOND[v // 32]) for v in firsts)


def test_stars_of_chains(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 5), (2000, 2001), (7, 7)] + [(5000 + k, 5000) for k in range(50)]
    got = {r.high: r.low for r in linked.stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 201)}, 1000: 0, 2001: 2000, **{5000 + k: 5000 for k in range(1, 50)}}


def test_no_documents(no_docs):
    assert simhash.join(no_docs).collect() == []


def test_query(spark, sf_dir):
    got = queries.op13(spark, sf_dir)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = got.collect()
    assert len(got) == len(rows) and all(r.fingerprint == f"{brute_fingerprint(rows[r.doc_id]):016x}" for r in got)
