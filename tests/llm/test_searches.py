"""Decontamination, personal data and licences against brute force."""
import re
from collections import Counter

import pytest
from .conftest import ascii_lower

from courtlake.llm import decontaminate, licenses, pii

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text):
    return re.findall(ALNUM, ascii_lower(text))


def _hits(text, items):
    words, hit, found = _words(text), set(), set()
    for item, other in items:
        w = _words(other)
        k = min(13, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            for i in range(len(words) - k + 1):
                if words[i:i + k] == w[j:j + k]:
                    hit.update(range(i, i + k))
                    found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.fixture(scope="module")
def bench(spark, texts):
    long = texts[-7] if len(texts[-7] or "") > 2000 else max((t for t in texts if t), key=len)
    shared = next(t for t in texts if t and t.count("\n") == 17)
    rows = [(1, " ".join(shared.split()[32:80]), 0), (2, "one", 0), (10, "another TEXT, under", 0), (3, None, 0), (4, "", 0), (5, "not there at all in any of these documents whatever they may hold or say", 0), (1, " ".join(long.split()[100:125]), 0), (None, "without an id", 0)]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id int")


@pytest.mark.parametrize("block_bytes", [4_000_000, 200])
def test_matches_equal_brute_force(docs, pairs, bench, block_bytes):
    items = [(str(r.item_id) if r.item_id is not None else "", r.text) for r in bench.collect()]
    got = decontaminate.judge(decontaminate.find_matches(docs, bench, block_bytes=block_bytes)).collect()
    expect = Counter((i, n, h, tuple(f), h > 0 and 20 * h >= n) for i, t in pairs for n, h, f in [_hits(t, items)])
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got) == expect


def test_near_matches_and_spans(spark):
    docs = spark.createDataFrame([(1, "zz alpha beta gamma delta epsilon"), (2, "alpha beta and gamma delta epsilon"), (3, "epsilon delta gamma beta alpha")], "doc_id int, text string")
    bench = spark.createDataFrame([("x", "alpha beta gamma delta epsilon")], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.judge(decontaminate.find_matches(docs, bench, slop=2)).collect()}
    assert [(s.start, s.end, s["item"], s.kind) for s in got[1].spans] == [(1, 6, "x", "phrase")]
    assert (got[2]["items"], got[2].near_items, got[2].contaminated) == ([], ["x"], False)
    assert got[3].near_items == []


def test_small_segments_give_the_same(docs, pairs, bench):
    one = decontaminate.build_index(docs, segment_words=300)
    assert one.count() > 3 and sum(len(r.ids) for r in one.select("ids").collect()) == len(pairs)


def test_decontamination_of_empty_tables(docs, no_docs, bench):
    assert decontaminate.find_matches(no_docs, bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == docs.count()
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _base(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(len(p.lstrip("0")) > 3 or int(p or 0) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and _luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, m.end(), kind))
    return [(k, s, e) for s, _, e, k in sorted(out)]


def test_personal_data_equals_the_patterns(docs, pairs):
    got = pii.find_pii(docs).select("doc_id", pii.only(pii.BASE).alias("spans")).collect()
    slow = [(i, (t or "").replace("x" * 20000, "x" * 50)) for i, t in pairs]         # the pattern alone is quadratic there
    fast = Counter((r.doc_id, len(r.spans)) for r in got)
    assert fast == Counter((i, len(_base(t))) for i, t in slow)
    texts = {t for _, t in pairs if t and len(t) < 5000}
    machine = pii._automaton()
    for t in texts:
        assert [(pii.KINDS[k], s, e) for s, k, e in pii.find_spans(t, machine) if k < 4] == _base(t)


def test_announced_identifiers():
    machine = pii._automaton()
    find = lambda t: [(pii.KINDS[k], t[s:e]) for s, k, e in pii.find_spans(t, machine)]
    assert find("IBAN: GB82 WEST 1234 5698 7654 32") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert find("IBAN: GB82 WEST 1234 5698 7654 33") == []
    assert find("SSN 123-45-6789, ssn 000-45-6789") == [("ssn", "123-45-6789")]
    assert find("account number 12345678") == [("account", "12345678")]
    assert find("discount 12345678") == []
    assert find("https://me:secret@host.example/x") == [("login", "me:secret")] or ("email", "secret@host.example") in find("https://me:secret@host.example/x")
    assert find('token = "1eb9c654e721b4f812088970e66a6345"') == [("secret", "1eb9c654e721b4f812088970e66a6345")]
    assert find("") == [] and find("nothing") == []


def test_personal_data_of_an_empty_table(no_docs):
    assert pii.find_pii(no_docs).count() == 0


def _licence(text):
    words, starts, labels = _words(text), [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i:i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), tuple(sorted(labels))


def test_licences(docs, pairs):
    found, name = licenses.scan(docs)
    assert name == "licence_" and found.columns[:-1] == docs.columns
    rows = found.collect()
    assert Counter((r.doc_id, r[name].n_words, r[name].n_base, r[name].first_word, r[name].last_word, tuple(r[name].base_labels)) for r in rows) == Counter((i, *_licence(t)) for i, t in pairs)
    by_text = {r.text: r[name] for r in rows}
    full = next(v for t, v in by_text.items() if t and t.startswith("Permission is hereby"))
    assert full.labels == ["mit"] and full.base_labels == [] and 0.5 <= full.score <= 1
    assert all(0 <= v.score <= 1 and set(v.base_labels) <= set(v.labels) for v in by_text.values())
    assert licenses.scan(docs.limit(0))[0].count() == 0
