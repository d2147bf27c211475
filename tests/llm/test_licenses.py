import re

from jurisloom.llm import licenses as lc

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def naive(text):
    """Detections by trying every rule and comparing every pair."""
    s = lc.scanner()
    words = (text or "").encode().translate(lc.TABLE).split()
    flat = b" " + b" ".join(words) + b" "
    found = [(m.start(), m.end(), k) for k in range(len(s.rules)) for m in s.pattern(k).finditer(flat)]
    for _, _, k in found:
        assert f" {s.rules[k].keyword}".encode() in flat, s.rules[k]

    def stronger(a, b):
        ra, rb = s.rules[a[2]], s.rules[b[2]]
        if ra.base:
            return False
        if (a[0], a[1]) == (b[0], b[1]):
            return a[2] < b[2]
        return a[0] <= b[0] and a[1] >= b[1] and ra.priority >= rb.priority

    kept = [b for b in found if s.rules[b[2]].base or not any(stronger(a, b) for a in found)]
    return sorted((flat.count(b" ", 1, b[0]) + (b[0] > 1) * 0, b[2]) for b in kept)


TEXTS = [
    None, "", "!!!", "mit license", "MIT LICENSE mit-license/mit license", "cc by cc by sa 4.0 CC-BY-NC-ND 4.0", "the GNU General Public License, version 3 or the gnu general public license",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: MIT-0 and Apache License v2",
    "éapache license apache licensé K mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files, mit license",
    "https://creativecommons.org/licenses/by-nc/4.0/ all rights reserved", "word " * 50_000 + "mit license " * 500,
]


def test_rules_are_many_and_ordered():
    table = lc.rules()
    assert len(table) > 300
    assert [r.priority for r in table] == sorted((r.priority for r in table), reverse=True)


def test_scan_against_brute_force():
    s = lc.scanner()
    for text in TEXTS[:-1]:
        _, spans = s.scan(text)
        assert sorted((a, k) for a, _, k in spans) == naive(text), text


def test_gaps_of_any_words():
    """Names of holders beyond ASCII or of many words, and other gaps with such words."""
    s = lc.scanner()
    bsd = "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software"
    gpl = "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (à votre choix) any later version"
    cases = [(bsd.format(x), "bsd-3-clause") for x in ("ACME", "Universität Zürich", "the " + "Regents and Friends of the University " * 12, "A nor the names of B")]
    cases += [(gpl.format(2), "gpl-2.0"), (gpl.format(3), "gpl-3.0"), ("may not be reproduced, même partiellement, without permission", "proprietary")]
    for text, label in cases:
        _, spans = s.scan(text)
        assert any(s.rules[k].label == label and (a, b) in ((0, len(text.encode().translate(lc.TABLE).split())), (0, text.count(" ") + 1)) for a, b, k in spans), text
    twice = bsd.format("Ä") + ". " + bsd.format("Ö")
    assert sum(s.rules[k].label == "bsd-3-clause" for *_, k in s.scan(twice)[1]) == 2
    assert not any(s.rules[k].label == "bsd-3-clause" for *_, k in s.scan("neither the name of " + "x " * 50_000 + "endorse or promote")[1])


def test_query(spark, tmp_path):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, "mit license", "y"), (3, "mit license", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, n_words string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lc.op1_license_scan(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for k, t in enumerate(TEXTS):
        r = by_id[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and r["labels"] == ",".join(sorted(r["labels"].split(",")))
    assert "apache-2.0" in by_id[7]["labels"]
    assert lc.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
