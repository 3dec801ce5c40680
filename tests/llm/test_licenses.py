"""Licence detections: base phrases against a plain search, rules, prefilter, priorities and containment."""

import os
import re

import pytest

from swatch.llm import license_rules, licenses

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    """n_words, n_base, first_word, last_word, base labels."""
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for label, phrase, _ in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels)


TEXTS = [
    None, "", " \n\t", "CC BY", "cc-by 4.0", "cc by cc by, CC/BY", "acc by", "cc bye", "ccby", "cc éby", "All rights  reserved.", "all RIGHTS\n\nreserved",
    "General Public License general public license", "general public licenses", "\U0001F600all rights reserved", "a general,public;license (all rights) reserved x",
    "Übung cc_by naïve", "word " * 60_000 + "all rights reserved" + " tail" * 50_000, "KELVIN cc by ſ", "\x00\x7fcc\x00by",
]


def found(spark, texts):
    df = spark.createDataFrame([(i, t, "clash", 3, 0.5) for i, t in enumerate(texts)],
                               "doc_id long, text string, labels string, row int, score double")
    return {r.doc_id: r for r in licenses.find_licenses(df).collect()}


def test_base_phrases(spark):
    got = found(spark, TEXTS)
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(t), t
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


CASES = {
    "SPDX-License-Identifier: Apache-2.0": ["apache-2.0"],
    "// spdx-license-identifier:GPL-2.0-or-later\n": ["gpl-2.0"],
    "SPDX-License-Identifier: MIT-0": ["mit-0"],
    "Released under the MIT License.": ["licensed", "mit"],
    "GNU Lesser General Public License,\n version 2.1": ["gpl", "lgpl-2.1"],  # gpl stays as a base phrase
    "the GNU General Public License v3": ["gpl", "gpl-3.0"],
    "Licensed under CC BY-NC-SA 4.0": ["cc-by", "cc-by-nc-sa-4.0"],
    "https://creativecommons.org/licenses/by-sa/3.0/": ["cc-by-sa-3.0"],
    "Creative Commons Attribution-ShareAlike 4.0 International License": ["cc-by-sa-4.0"],
    "Mozilla Public License": ["mpl"], "mozilla public license, v. 2.0": ["mpl-2.0"],
    "Redistribution and use in source and binary forms, with or without\n# modification, are permitted": ["bsd-2-clause"],
    "Permission is hereby granted, free of charge, to any person obtaining a copy": ["mit"],
    "Copyright (c) 2019-2021 Some One": ["copyright"],
    "permission of the public": [], "a submitted licence": [], "submit license": [],
}


def test_rules(spark):
    got = found(spark, list(CASES))
    assert {t: got[i].labels for i, t in enumerate(CASES)} == CASES


def test_containment_and_places(spark):
    text = "\U0001F600 Under the GNU General Public License, version 3. GPL. Apache License 2.0, Apache License"
    parts = found(spark, [text])[0].parts
    assert [(p.label, text[p.start:p.end]) for p in parts] == [
        ("gpl-3.0", "GNU General Public License, version 3"), ("gpl", "GPL"), ("apache-2.0", "Apache License 2.0"),
        ("apache", "Apache License")]
    assert [p.start for p in parts] == sorted(p.start for p in parts)


def test_keywords_are_in_whatever_a_rule_matches():
    table = license_rules.rules()
    assert len(table) > 300 and [r.tier for r in table] == sorted(r.tier for r in table)
    for r in table:
        sure = license_rules.certain(r.pattern.removeprefix("(?i)").replace(r"\(?", ""))
        assert any(k in license_rules.ANCHORS for k in r.keywords), r
        assert all(k in sure for k in r.keywords), (r, sure)


def test_native_and_empty(spark, none, odd):
    out = licenses.find_licenses(odd)
    assert not re.search("EvalPython|InArrow|InPandas", out._jdf.queryExecution().executedPlan().toString())
    assert out.count() == odd.count() and licenses.find_licenses(none).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_over_the_whole_table(spark):
    import __spark_entry__ as entry

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in entry.queries()["op11_licenses"](spark, SF).collect()}
    assert {i: (*plain(t)[:4], ",".join(plain(t)[4])) for i, t in docs} == {i: tuple(r)[1:6] for i, r in got.items()}
