"""Notices wrapped over lines, and notices of similar licenses."""

import random

import pytest

from tessera.llm import licenses

WRAPPED = {
    "mit": "/* Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the \"Software\"), to deal\n */",
    "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:",
    "isc": "Permission to use, copy, modify, and/or distribute this software\nfor any purpose with or without fee is\nhereby granted, provided",
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public\nLicense as",
    "cc-by-sa": "This work is licensed under a Creative\nCommons Attribution-ShareAlike 4.0\nInternational License.",
    "lgpl": "under the terms of the GNU Lesser General\nPublic License as published by the\nFree Software Foundation",
}


def labels(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(docs).collect()}


def test_wrapped_notices_are_found(spark):
    found = labels(spark, ["First a line of prose.\n" + t + "\nand more prose" for t in WRAPPED.values()])
    assert all(label in found[i] for i, label in enumerate(WRAPPED))


def test_similar_notices_are_not_taken_for_one_another(spark):
    found = labels(spark, ["released under the Apache License", "under the terms of the GNU General Public License as published by the Free Software Foundation", "This work is licensed under a Creative Commons Attribution 4.0 International License", "This work is licensed under the GNU General Public License, version 2"])
    assert "mit" not in found[0] and not found[1] & {"lgpl", "agpl"} and "cc-by-sa" not in found[2] and "cc-by" in found[2] and "gpl-3" not in found[3]


@pytest.mark.parametrize("seed", range(40))
def test_windows_are_those_of_brute_force(seed):
    rng = random.Random(seed)
    vocabulary = [w for _, t in licenses.TEMPLATES[seed % 15 :][:2] for w in licenses.words_of(t.encode())] + [b"other"] * 3
    words = [rng.choice(vocabulary) for _ in range(120)]
    index = licenses.TemplateIndex({w: rng.randrange(50) for w in vocabulary} if seed % 2 else {})
    want = {}
    for label, t in licenses.TEMPLATES:
        listed = licenses.words_of(t.encode())
        own, span = set(listed), -(-5 * len(listed) // 4)
        for i in range(len(words)):
            block = own & set(words[i : i + span])
            if len(block) >= licenses.CONTAINMENT * len(own) - 1e-9 and own & licenses.TELLING <= block:
                want[label] = max(want.get(label, 0), len(block) / len(own))
    assert index.find_windows(words, licenses.TELLING) == want


def test_filters_leave_out_places_that_cannot_reach():
    index = licenses.TemplateIndex({w: 100 for w in (b"the", b"of", b"this", b"is", b"under")})
    (at,) = [k for k, (_, t) in enumerate(licenses.TEMPLATES) if t.startswith("Released under")]
    _, order, _, need = index.templates[at]
    span = index.spans[at]

    def reaches(text):
        words = licenses.words_of(text)
        known = [i for i, w in enumerate(words) if w in index.rank]
        ranks = [index.rank[words[i]] for i in known]
        (k,) = [k for k, i in enumerate(known) if words[i] == order[0]]
        return index._reaches(known, ranks, k, span, len(order), need)

    first = order[0]
    assert reaches(b" ".join([b"x", *order, b"x"]))
    assert not reaches(b"x x " + first + b" x x")  # length: too few known words
    assert not reaches(first + b" this is this is this")  # positional: too few distinct ones from there on
    before = sorted((w for w in index.rank if index.rank[w] < index.rank[first]), key=index.rank.get)[:4]
    assert not before or not reaches(b" ".join([*before, first]))  # positional: the others come earlier in the order


def test_scattered_words_are_no_notice(spark):
    found = labels(spark, ["the boat was released in may and the driver lost his license under a bridge; der Mann ging mit dem Hund", " ".join(w + " x y z" for w in licenses.TEMPLATES[3][1].split())])
    assert found == {0: {""}, 1: {""}}


def test_places_of_very_many_phrases_take_linear_time():
    words = licenses.words_of(b"cc by " * 100_000)
    assert licenses.base_places(words)[-1] == (199_998, "cc-by") and len(licenses.base_places(words)) == 100_000
