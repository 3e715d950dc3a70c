import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, n int, row int, spans string, quality string, licence string, n_removed int, spaced string, h long"


def _texts():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k)).capitalize() + "."
    passage = [line(9) for _ in range(10)]
    base = [line(rng.randint(6, 12)) for _ in range(12)]
    texts = [None, "", " \n\t ", "one", "One two three", "one TWO three", "İstanbul K Élan ÉLAN ß 中文 😀 mit", "a  b   c \r\n d"]
    texts += ["\n".join(base)] * 3
    for k in range(40):                                     # near copies: one word of the base differs
        near = " \n".join(base).split(" ")
        near[rng.randrange(len(near))] = f"w{k}"
        texts.append(" ".join(near))
    for k in range(12):                                     # a passage that many documents share
        texts.append("\n".join([line(8) for _ in range(4)] + passage + [line(8) for _ in range(4)]))
    texts += ["\n".join(line(rng.randint(1, 14)) for _ in range(rng.randint(1, 20))) for _ in range(40)]
    texts.append("\n".join(line(10) for _ in range(1500)))  # very long
    texts.append(" ".join(["same"] * 3000))
    texts.append("x" * 20000 + "@" + "1" * 5000 + "." + "+" * 300)
    texts.append("Released under the MIT License. Licensed under CC BY-NC 4.0. under the mit license under the MIT license")
    texts.append("Permission is hereby granted, free of charge, to any person obtaining a copy of this software, without restriction. mit license")
    texts.append("mail me.now+x@mail.example.com, or +1 (499) 555-6503; 10.0.0.255 999.1.1.1 1.2.3.4.5.6.7.8 card 4111 1111 1111 1111 token = \"1eb9c654e721b4f812088970e66a6345\" a@b @c.d x@y.z@q.r")
    return texts


@pytest.fixture(scope="session")
def texts():
    return _texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, "hot" if i % 2 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [(3, "one", "en", "hot", 3), (3, "another text under the id three", None, None, 1), (None, "a row without an id", "en", "hot", 1), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, 1, 2, 3, "s", "q", "l", 4, "x", 5) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def pairs(docs):
    """Every row's id and text, in no order."""
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
