"""Files that hold several full notices, and notices in long prose."""
import random

from courtlake.llm import licenses


def test_every_full_notice_is_found(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("bcdfghjklm") for _ in range(7)) for _ in range(n))
    notices = [(label, words) for label, words, _ in licenses.TEMPLATES]
    other = sorted({w for _, words in notices for w in words.split() if w not in licenses.FUNCTION_WORDS})
    rows, expect = [(0, f" {prose(30)} ".join(w for _, w in notices))], {0: {label for label, _ in notices}}
    for k, (label, words) in enumerate(notices, 1):            # one notice, and single words of all others in long prose
        rows.append((k, " ".join(f"{prose(9)} {w}" for w in other) + f" {prose(500)} {words} {prose(500)}"))
        expect[k] = {label}
    for a in range(len(notices)):
        for b in range(a):
            rows.append((len(rows), f"{notices[a][1]} {prose(20)} {notices[b][1]}"))
            expect[len(rows) - 1] = {notices[a][0], notices[b][0]}
    rows.append((len(rows), " ".join(f"{prose(9)} {w}" for w in other)))
    expect[len(rows) - 1] = set()
    found, name = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    missed = {r.doc_id: expect[r.doc_id] - set(r[name].labels) for r in found.collect()}
    assert not {k: v for k, v in missed.items() if v}
    none = next(r for r in found.where(f"doc_id = {len(rows) - 1}").collect())
    assert none[name].labels == []
