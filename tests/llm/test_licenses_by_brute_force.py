"""Notices that differ in a deciding word, scattered fragments, and all chains by brute force."""

import random
import time

import pytest
from test_texts import WORD, base_places

from quarry.llm import licenses

NOTICES = {
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": ("", "lgpl"),
    "under the terms of the GNU Affero General Public License version 3": ("", "agpl"),
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License": ("gpl", "gpl"),
    "Photo: CC BY-NC-SA 4.0": ("cc-by", "cc-by,cc-by-nc-sa"),
    "Photo: CC BY-NC 4.0": ("cc-by", "cc-by,cc-by-nc"),
    "Licensed under CC BY-SA": ("cc-by", "cc-by,cc-by-sa"),
    "Licensed under CC BY 4.0": ("cc-by", "cc-by"),
    "Licensed under the Apache License, Version 2.0": ("apache", "apache"),
    "You may obtain a copy; you may not use this file, except in strict compliance with the License.": ("", "apache"),
    "documentation files, free of charge and software to any person; associated obtaining a copy is hereby granted of this Permission": ("", ""),
    "the license with the compliance in except this file use may not you": ("", ""),
    "no license here": ("", ""),
}


def chain(matches, gap):
    """The most matches (p, q) in a row, by trying all predecessors."""
    best = {}
    for p, q in sorted(matches, key=lambda m: (m[1], m[0])):
        before = [b for (a, c), b in best.items() if a < p and c < q and abs((p - q) - (a - c)) <= gap]
        best[p, q] = max(before, default=frozenset(), key=len) | {q}
    return max(best.values(), key=len, default=frozenset())


def brute_labels(text):
    w = WORD.findall(text.lower())
    out = set(base_places(text)[2].split(",")) - {""}
    for phrase, (label, deciding) in licenses.TEMPLATES.items():
        t = phrase.split()
        grams = list(zip(t, t[1:]))
        matches = [(p, q) for p, pair in enumerate(zip(w, w[1:])) for q, g in enumerate(grams) if g == pair]
        votes = {}
        for p, q in matches:
            votes[p - q] = votes.get(p - q, 0) + 1
        found = chain([(p, q) for p, q in matches if votes[p - q] >= min(2, len(grams))], licenses.GAP)
        if len(found) >= licenses.MIN_SHARE * len(grams) and all(q in found for q, g in enumerate(grams) if " ".join(g) in deciding):
            out.add(label)
    return out


def labels_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["base_labels"], r["labels"]) for r in licenses.scan(df)[1].orderBy("doc_id").collect()]


def test_notices(spark):
    assert dict(zip(NOTICES, labels_of(spark, list(NOTICES)))) == NOTICES


def test_edited_notices_as_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(250):
        phrase = rng.choice([p for p in licenses.TEMPLATES if len(p.split()) > 6])
        w = phrase.split()
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], ["word"], [w[k], "put", "in"], [w[k]]]) or ["x"] * (len(w) == 1)
        if rng.random() < 0.2:
            cut = rng.randrange(len(w))
            w = w[cut:] + w[:cut]
        texts.append(" ".join(["some", "words"] * rng.randrange(4) + w + ["and", "more"] * rng.randrange(4)))
    got = [set(x.split(",")) - {""} for _, x in labels_of(spark, texts)]
    want = [brute_labels(t) for t in texts]
    assert got == want and 50 < sum(map(bool, want)) < 250


def test_work_is_linear(spark):
    rng = random.Random(1)
    took = {}
    for n in (50_000, 200_000):
        df = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(n)) + " released under the MIT license") for i in range(2)], "doc_id long, text string")
        licenses.scan(df.limit(1))[1].collect()
        began = time.time()
        assert [r["labels"] for r in licenses.scan(df)[1].collect()] == ["mit", "mit"]
        took[n] = time.time() - began
    assert took[200_000] < 30


@pytest.mark.parametrize("text", ["in the " * 5_000, "this work is licensed under the gnu general public license version 3 " * 200])
def test_repeated_grams(spark, text):
    assert len(labels_of(spark, [text])) == 1
