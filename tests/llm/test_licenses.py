import re

from lexicrate.llm.license_rules import signatures
from lexicrate.llm.licenses import BASE, gates, op2_license_scans, rules, scan_licenses

from .helpers import LETTERED, LOWER, frame, odd_texts


def words(t):
    return LETTERED.findall((t or "").translate(LOWER))


def brute(text):
    """(base places, detections that stay) of one text."""
    w = words(text)
    padded = " " + " ".join(w) + " "
    base = [
        (i, label)
        for phrase, label in BASE.items()
        for i in range(len(w))
        if w[i : i + len(phrase.split())] == phrase.split()
    ]
    found = []
    for k, (label, keyword, pattern, priority, confidence) in enumerate(rules()):
        if keyword in padded[1:-1]:
            for m in re.finditer(rf"(?<= )(?:{pattern})(?= )", padded):
                start = padded[: m.start()].count(" ") - 1
                found.append((start, start + m.group().count(" ") + 1, label, priority, confidence, k))
    kept = [
        d for d in found
        if not any(
            e[0] <= d[0] and e[1] >= d[1] and e != d
            and (e[3] < d[3] or e[3] == d[3] and ((e[1] - e[0]) > (d[1] - d[0]) or e[5] < d[5]))
            for e in found
        )
    ]
    return sorted(base), sorted(kept)


TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the License); all rights reserved.",
    "CC BY CC-BY-SA 4.0 cc by cc by",
    "SPDX-License-Identifier: MIT\nCopyright (c) 2019, 2020 Nobody. All Rights Reserved. All rights reserved",
    "This is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation, either version 3 of the License.",
    "Redistribution and use in source and binary forms, permitted under the BSD 3-Clause license; bsd license bsd license",
    "Creative Commons Attribution-NonCommercial 4.0 International License, without any warranty",
    "mit mit permit emit license mit", "the general public licenses", "no notice at all",
]


def test_rules_are_many_and_valid():
    assert len(rules()) > 250
    assert all(re.compile(p) and 1 <= prio <= 9 and 0 < c <= 1 for _, _, p, prio, c in rules())


def test_every_signature_finds_its_example():
    assert len(signatures()) > 200
    for label, keyword, pattern, priority, _, example in signatures():
        found = re.search(rf"(?<= )(?:{pattern})(?= )", f" {' '.join(words(example))} ")
        assert found and found.group() == example, pattern
        assert keyword in found.group() and 1 <= priority <= 4 and label
    assert len({pattern for _, _, pattern, *_ in signatures()}) == len(signatures())


def test_gates_let_every_keyword_pass():
    for _, keyword, *_ in rules():
        assert any(g in keyword for g in gates()), keyword


def test_query_on_small_tables(spark, tmp_path):
    examples = [e for *_, e in signatures()]
    texts = odd_texts() + list(enumerate(TEXTS, 100)) + list(enumerate(examples[::9], 300))
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in texts:
        base, found = brute(t)
        labels = {x for _, x in base}
        score = max([d[4] for d in found] + ([0.5] if base else []), default=0.0)
        starts = [p for p, _ in base]
        want.append((repr(i), len(words(t)), len(base), min(starts, default=None), max(starts, default=None),
                     ",".join(sorted(labels)), ",".join(sorted(labels | {d[2] for d in found})), score))
    got = [(repr(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)
           for r in op2_license_scans(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_spans_and_suppression(spark):
    texts = odd_texts() + list(enumerate(TEXTS, 100)) + [(200, " ".join(TEXTS) * 5)]
    texts += [(300 + k, "so " + e.upper() + " it is") for k, (*_, e) in enumerate(signatures())]
    out = scan_licenses(frame(spark, texts)).collect()
    got = sorted(
        (repr(r.doc_id), r.n_words, sorted(map(tuple, r.base)), sorted(map(tuple, r.detections))) for r in out
    )
    want = sorted((repr(i), len(words(t)), *brute(t)) for i, t in texts)
    assert got == want


def test_empty_table(spark):
    assert scan_licenses(frame(spark, [])).count() == 0
