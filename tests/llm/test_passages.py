"""Repeated passages of some fifty words and more, wherever they stand."""
import random
from collections import Counter

import pytest

from courtlake.llm import linededup

SEPARATORS = [" ", "\n", "? ", "! ", ". ", "。 "]


def _planted(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    prose = lambda n: "".join(word() + (rng.choice(SEPARATORS) if rng.random() < 0.1 else " ") for _ in range(n)).strip()
    passages, rows = [], []
    for k in range(60):
        passages.append(prose(rng.randint(51, 100)) if k % 2 else " ".join(word() for _ in range(rng.randint(51, 100))))
        for c in range(3):
            rows.append((3 * k + c, f"{prose(rng.randint(0, 90))} {passages[-1]} {prose(rng.randint(0, 90))}".strip(), "extra"))
    return passages, rows


def test_planted_passages_stay_once(spark):
    passages, rows = _planted(8)
    cleaned, removed = linededup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string, n_removed string").repartition(4))
    assert removed == "n_removed_"
    got = {r.doc_id: r for r in cleaned.collect()}
    for i, text, _ in rows:
        own = passages[i // 3].split()
        expect = text.split()
        if i % 3:
            at = next(a for a in range(len(expect)) if expect[a:a + len(own)] == own)
            expect = expect[:at] + expect[at + len(own):]
        assert got[i].text.split() == expect and got[i][removed] == bool(i % 3)


def test_corner_cases(spark):
    rng = random.Random(1)
    own = [f"w{rng.random()}" for _ in range(60)]
    base, other = " ".join(own), "a text of its own"
    rows = [(None, base), (None, None), (1, ""), (2, other), (3, base), (3, base), (4, f"{other}\n{base}\n{base}\nend"), (5, "same " * 3000)]
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.text, r.n_removed) for r in linededup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()), key=repr)
    assert sorted([(False, 0, base, 0), (False, 0, None, 0), (True, 1, "", 0), (True, 2, other, 0), (True, 3, "", 1), (True, 3, "", 1), (True, 4, f"{other}\nend", 1)], key=repr) == [r for r in got if r[1] != 5]
    assert {w for r in got if r[1] == 5 for w in r[2].split()} == {"same"}


def test_equal_hashes_of_unequal_chunks_remove_nothing(spark, monkeypatch):
    _, rows = _planted(9)
    rows = [r for r in rows if r[0] % 3 == 0]
    real = linededup.cut_chunks
    monkeypatch.setattr(linededup, "cut_chunks", lambda texts: (*(got := real(texts))[:3], got[3] % 3))
    got = linededup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string, x string"))[0].collect()
    assert {(r.doc_id, r.text, r.n_removed) for r in got} == {(i, t, 0) for i, t, _ in rows}


@pytest.mark.parametrize("n", [51, 52, 60, 100])
def test_two_places_of_enough_words_share_a_chunk(n):
    """The recall of repeats of ``SURE`` words and more is 1, on lines and sentences of any length."""
    rng = random.Random(n)
    word = lambda: str(rng.random()) + rng.choice(["", "", "", ".", "\n", "?"])
    for _ in range(200):
        same = [word() for _ in range(n)]
        around = lambda: [word() for _ in range(rng.randint(0, 80))]
        of, _, _, h = linededup.cut_chunks([" ".join(around() + same + around()) for _ in range(2)])
        assert set(h[of == 0].tolist()) & set(h[of == 1].tolist())


def test_chunks_do_not_depend_on_the_texts_beside_them(texts):
    texts = [t for t in texts if t] + ["\u3000 \xa0".join(f"k{i % 40}\u2003é\x1c中。" for i in range(90)), "z" * 3000000 + " a b c" * 9]
    of, at, n, h = linededup.cut_chunks(texts)
    for k, text in enumerate(texts):
        alone = linededup.cut_chunks([text])
        assert [x.tolist() for x in (at[of == k], n[of == k], h[of == k])] == [x.tolist() for x in alone[1:]]
        words, same = text.split(), {}
        for a, m, x in zip(*(y.tolist() for y in alone[1:])):
            assert same.setdefault(x, words[a:a + m]) == words[a:a + m]        # one hash, one run of words as str.split parts them
        assert all(a + m <= len(words) and m >= linededup.LEAST_WORDS for a, m in zip(alone[1].tolist(), alone[2].tolist()))


def test_against_brute_force(spark, pairs):
    """What goes stands at an earlier place; of stretches of ``SURE`` words and more, none is left twice."""
    n = linededup.SURE
    rows = [(i, t) for i, t in pairs if i is not None and i != 3 and t and t != " ".join(["same"] * 3000)]
    got = {r.doc_id: r.text for r in linededup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))[0].collect()}
    grams = lambda words, k: [tuple(words[a:a + k]) for a in range(len(words) - k + 1)]
    seen, kept = set(), Counter()
    for i, text in sorted(rows):
        words, left = text.split(), got[i].split()
        at = 0
        for w in left:                                      # what stays, stays in its order
            at = words.index(w, at) + 1
        if not seen & set(grams(words, linededup.LEAST_WORDS)):
            assert len(set(grams(words, linededup.LEAST_WORDS))) < len(grams(words, linededup.LEAST_WORDS)) or left == words
        seen |= set(grams(words, linededup.LEAST_WORDS))
        kept.update(set(grams(left, n)))
    before = Counter(g for _, t in rows for g in set(grams(t.split(), n)))
    assert max(before.values()) > 10 and not [g for g, k in kept.items() if k > 1]


def test_an_empty_table(no_docs):
    assert linededup.dedup_passages(no_docs)[0].count() == 0
