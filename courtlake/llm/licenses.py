"""Licence scan by a positional index of template words, in DataFrame functions only.

Licence templates are word sequences; their words but for function words are indexed by place. The index is small and
fixed, so all of its words that a file holds are looked up. Every place of
such a word in the file and in a template gives the place where that template would start, and a template is aligned
where several words agree on it. It counts if ``NEEDED`` / 2 words agree (half of the words of a short template), two at
least, and the file holds the template's mandatory phrases. Short base phrases are found wherever they stand, aligned or not.

Defined cases: a null text is empty; an empty text has no words, no labels and score 0; rows are judged one by one, so
repeated rows repeat the result; further columns pass through, whatever their names.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_column
from .quality import bound

# fixed values: phrases whose places are counted, and their labels
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# fixed values: label, words of a notice, phrases without which it does not count
TEMPLATES = [
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license", "version 2")),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("public-domain", "this is free and unencumbered software released into the public domain", ("public domain",)),
    ("reserved", "copyright all rights reserved", ("all rights reserved",)),
]
# fixed values: words too common to look up
FUNCTION_WORDS = frozenset("a all and any are by can for form forms free in is it may not of or person source terms that the this to under use with without work you 0 2 3 4 v".split())

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NEEDED, ALIGNED_LOOKBACK = 6, 5


def _postings() -> list[tuple[str, int, int]]:
    return [(w, t, p) for t, (_, words, _) in enumerate(TEMPLATES) for p, w in enumerate(words.split()) if w not in FUNCTION_WORDS]


def spaced(text: Column) -> Column:
    """The words, lower-cased in A-Z, each with a space of its own on either side."""
    odd = text.rlike("[İK]")                       # their lower case would be an ASCII letter
    low = F.when(odd, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))
    bare = F.btrim(F.regexp_replace(low, _SEPARATORS, "  "), F.lit(" "))
    return F.when(bare == "", "").otherwise(F.concat(F.lit(" "), bare, F.lit(" ")))


def _count(spaced_text: Column) -> Column:
    return ((F.length(spaced_text) - F.length(F.replace(spaced_text, F.lit(" "), F.lit("")))) / 2).cast("long")


def _phrase(words: str) -> str:
    return "".join(f" {w} " for w in words.split())


def scan(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` and one struct column with places, labels and score; its name."""
    taken, name, raw = {c.lower() for c in docs.columns}, "licence", "spaced"
    while name in taken:
        name += "_"
    while raw in taken:
        raw += "_"
    postings = _postings()
    vocabulary = sorted({w for w, _, _ in postings})
    indexed = F.array(*[F.lit(w) for w in vocabulary])
    index = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(t).alias("t"), F.lit(p).alias("p")) for w, t, p in postings])

    def aligned(words: Column) -> Column:
        """Per template, how many words agree on one start."""
        def starts(held: Column) -> Column:
            hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: F.array_contains(held, h["w"]))
            pairs = F.flatten(F.transform(hits, lambda h: F.transform(F.filter(index, lambda p: p["w"] == h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["p"]).alias("d"), p["p"].alias("p")))))
            return F.array_sort(pairs)

        def runs(s: Column) -> Column:
            near = lambda x, j: sum((F.coalesce((F.get(s, j - k)["t"] == x["t"]) & (F.get(s, j - k)["d"] == x["d"]), F.lit(False)).cast("int") for k in range(1, ALIGNED_LOOKBACK + 1)), F.lit(1))
            return F.transform(s, lambda x, j: F.struct(x["t"].alias("t"), near(x, j).alias("n")))

        best = lambda r: F.array(*[F.coalesce(F.array_max(F.transform(F.filter(r, lambda x: x["t"] == t), lambda x: x["n"])), F.lit(0)) for t in range(len(TEMPLATES))])
        return bound(bound(bound(F.array_intersect(indexed, words), starts), runs), best)

    text = F.col(raw)
    words = F.split(F.btrim(text, F.lit(" ")), "  ")
    known = F.size(F.array_intersect(words, indexed)) > 0
    none = F.array(*[F.lit(0)] * len(TEMPLATES))
    agree = F.when(known, bound(words, aligned)).otherwise(none)

    def places(phrase: str) -> Column:
        parts = F.split(text, F.lit(_phrase(phrase)), -1)                                    # letters, digits and spaces: no pattern
        last = lambda p: _count(text) - _count(F.element_at(p, -1)) - len(phrase.split())
        found = bound(parts, lambda p: F.struct((F.size(p) - 1).cast("long").alias("n"), _count(F.element_at(p, 1)).alias("first"), last(p).alias("last")))
        empty = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
        return F.when(F.contains(text, F.lit(_phrase(phrase))), found).otherwise(empty)

    def verdict(base: Column, counts: Column) -> Column:
        labels, shares = [], []
        for t, (label, notice, phrases) in enumerate(TEMPLATES):
            need = min(NEEDED, sum(w not in FUNCTION_WORDS for w in notice.split()))
            ok = (counts[t] >= 2) & (2 * counts[t] >= need)
            for p in phrases:
                ok &= F.contains(text, F.lit(_phrase(p)))
            labels.append(F.when(ok, F.lit(label)))
            shares.append(F.when(ok, F.least(counts[t], F.lit(need)) / need).otherwise(F.lit(0.0)))
        own = [F.when(base[k]["n"] > 0, F.lit(label)) for k, label in enumerate(BASE.values())]
        tidy = lambda a: F.array_sort(F.array_distinct(F.array_compact(F.array(*a))))
        n = sum((base[k]["n"] for k in range(len(BASE))), F.lit(0))
        return F.struct(_count(text).alias("n_words"), n.alias("n_base"), F.array_min(F.transform(base, lambda b: b["first"])).alias("first_word"), F.array_max(F.transform(base, lambda b: b["last"])).alias("last_word"), tidy(own).alias("base_labels"), tidy(own + labels).alias("labels"), F.when(n > 0, F.lit(1.0)).otherwise(F.greatest(*shares)).alias("score"))

    result = bound(F.array(*[places(p) for p in BASE]), lambda base: bound(agree, lambda counts: verdict(base, counts)))
    return docs.withColumn(raw, spaced(text_column(docs, text_col))).select(*docs.columns, result.alias(name)), name
